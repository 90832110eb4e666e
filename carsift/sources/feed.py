"""Fetched pages as a Spark data source, and the sources' extractors looked up by configuration.

`<root>/source=<name>/*.parquet` holds what a fetcher wrote: page_id, url, html. `spark.read.format("carsift_pages")` plans one
partition per source and row group; `spark.readStream` remembers the last file name of every source, so a batch is what arrived
since (file names must sort by arrival, as batch numbers do). Both give the rows of the files named, in whatever folder the file
system of the root offers (local, HDFS, object stores).

Files without rows give none; a source without a folder or without files has no partitions; null pages stay null pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from carsift.operators.filters import active_searches
from carsift.sources.dictionaries import builtin
from carsift.sources.extract import REGISTRY

SCHEMA = "source string, page_id long, url string, html string"
FORMAT = "carsift_pages"


class Piece(InputPartition):
    """One row group of a source's file."""

    def __init__(self, source: str, path: str, group: int):
        self.source, self.path, self.group = source, path, group


class _Folder:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.asked = [s for s in options.get("sources", "").split(",") if s]

    def open(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        return system, path.rstrip("/")

    def files(self) -> dict[str, list[str]]:
        """Files of every source by name; unfinished and hidden ones are left out."""
        from pyarrow import fs

        system, root = self.open()
        out: dict[str, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            folder, _, name = info.path[len(root) + 1 :].rpartition("/")
            source = folder.removeprefix("source=")
            if info.is_file and name.endswith(".parquet") and name[0] not in "._" and folder.startswith("source=") and (not self.asked or source in self.asked):
                out.setdefault(source, []).append(name)
        return {s: sorted(names) for s, names in sorted(out.items())}

    def pieces(self, chosen: dict[str, list[str]]) -> list[Piece]:
        from pyarrow import parquet

        system, root = self.open()
        paths = [(s, f"{root}/source={s}/{n}") for s, names in chosen.items() for n in names]
        return [Piece(s, p, g) for s, p in paths for g in range(parquet.ParquetFile(p, filesystem=system).num_row_groups)]

    def rows(self, piece: Piece) -> Iterator:
        import pyarrow as pa
        from pyarrow import parquet

        system, _ = self.open()
        for batch in parquet.ParquetFile(piece.path, filesystem=system).iter_batches(row_groups=[piece.group], columns=["page_id", "url", "html"], batch_size=1024):
            columns = [batch.column(n).cast(t) for n, t in (("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array([piece.source] * batch.num_rows, pa.string()), *columns], ["source", "page_id", "url", "html"])


class PageReader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Piece]:
        return self.folder.pieces(self.folder.files()) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator:
        return self.folder.rows(partition) if isinstance(partition, Piece) else iter(())


class PageStreamReader(DataSourceStreamReader):
    """Offsets are {source: last file name}; a source that appears later starts at its first file."""

    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: names[-1] for s, names in self.folder.files().items()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        files = self.folder.files()
        return self.folder.pieces({s: [n for n in files.get(s, []) if start.get(s, "") < n <= last] for s, last in end.items()})

    def read(self, partition: Piece) -> Iterator:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(_Folder(self.options))

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(_Folder(self.options))


# ---- the registry in use ------------------------------------------------------------------------------------------
def detail_sources() -> list[str]:
    """Sources whose detail pages can be read."""
    return sorted(s for s, (_, detail) in REGISTRY.items() if detail is not None)


def extractors_for(search: dict) -> list[tuple[str, dict]]:
    """(source, defaults for index rows) of a search; a source nobody registered is an error."""
    wanted = search.get("sources") or [search["source"]]
    unknown = [s for s in wanted if s.lower() not in REGISTRY]
    if unknown:
        raise ValueError(f"no extractor is registered for {', '.join(unknown)}")
    return [(s.lower(), {"brand": search.get("marque", ""), "model": search.get("modele", "")}) for s in wanted]


def enabled_sources(spark: SparkSession, searches: list[dict] | None = None) -> list[str]:
    """Sources of all enabled searches."""
    used = builtin("searches")["searches"] if searches is None else searches
    rows = spark.createDataFrame([(s["name"], s.get("enabled", True), s.get("sources"), s.get("source")) for s in used], "name string, enabled boolean, sources array<string>, source string")
    return sorted(r[0] for r in active_searches(rows).select("search_source").distinct().collect())


def scan_pages(pages: DataFrame, search: dict) -> DataFrame:
    """Index rows of fetched pages (source, page_id, url, html) by the extractors of a search, first occurrence per listing id."""
    parts = [REGISTRY[s][0](pages.where(F.col("source") == s), **defaults) for s, defaults in extractors_for(search)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.drop("pos") for p in parts])


def details_of(pages: DataFrame) -> DataFrame:
    """Detail rows of fetched detail pages of all sources that have a detail extractor."""
    return reduce(DataFrame.unionByName, [REGISTRY[s][1](pages.where(F.col("source") == s)) for s in detail_sources()])


def read_pages(spark: SparkSession, root: str, sources: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format(FORMAT).option("sources", ",".join(sources or [])).load(root)


def stream_pages(spark: SparkSession, root: str, sources: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.readStream.format(FORMAT).option("sources", ",".join(sources or [])).load(root)


def scan_stream(spark: SparkSession, root: str, search: dict, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the index rows of every batch of new pages to `target`, one folder per batch, so a replay rewrites its own."""

    def one(batch: DataFrame, number: int) -> None:
        scan_pages(batch, search).write.mode("overwrite").parquet(f"{target}/batch={number}")

    names = [s for s, _ in extractors_for(search)]
    writer = stream_pages(spark, root, names).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
