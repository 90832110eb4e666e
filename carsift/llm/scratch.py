"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from carsift.session import shuffles_removed

_folder: ContextVar[str | None] = ContextVar("folder", default=None)  # of the operator call that is being run, if it has one


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return (named or "file://" + tempfile.mkdtemp(prefix="carsift-")).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_folder.get() or shared_dir(spark)}/carsift-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back, so a lost executor costs no earlier work."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffles_removed(df.sparkSession):  # the rows are read from the table from now on
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Writes the rows of make() and removes all that was written while making them; only the result stays."""
    result, folder = scratch_path(spark, name), scratch_path(spark, f"{name}-steps")
    before = _folder.set(folder)
    try:
        rows = make()
        with shuffles_removed(spark):
            rows.write.parquet(result)
        return spark.read.schema(rows.schema).parquet(result)
    finally:
        _folder.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused_name(docs: DataFrame) -> str:
    """A column name that docs does not have, so no input column can clash with it."""
    return "found_" + "_" * max(len(c) for c in docs.columns)
