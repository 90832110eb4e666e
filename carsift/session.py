"""Session settings used by the tests and the benchmark; a cluster supplies its own."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "carsift", shuffle_partitions: int | None = None) -> SparkSession:
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CARSIFT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # generated methods above 8000 bytes of bytecode are never JIT-compiled by the JVM; below this limit
        # Spark keeps whole-stage codegen, above it it splits the expressions into small compiled methods
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # the test tables are single small files; a cluster leaves this unset and scans keep their splits
        .config("spark.carsift.scan.partitions", str(parts))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def compiled(spark: SparkSession) -> SparkSession:
    """The session, with the limit above for methods that Spark generates: a cluster's default keeps methods of the scoring
    expressions that the JVM only ever interprets. A lower limit that a session asks for stays."""
    name, most = "spark.sql.codegen.hugeMethodLimit", 8000
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))
    return spark


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what runs inside as soon as it ends; otherwise they stay on the executors' disks until
    the driver's garbage collector comes upon them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the cluster names, else a temporary one (tests on one machine only)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return "file://" + tempfile.mkdtemp(prefix="carsift-checkpoints-")
