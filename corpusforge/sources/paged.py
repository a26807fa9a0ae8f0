"""Folders that list their children in pages: a Python data source, and a walk of what is below.

A listing answers with pages: the children of a folder, so many at a time, each page with
the number of the next. The data source reads one from a table of entries that all
machines reach (Parquet files of ``parent``, ``child``, ``is_folder``, ``seq``), as a remote
drive would give it: a partition for each file, whose entries come in pages of ``pageSize``
rows, only columns and row groups that a page needs in memory. As a stream it gives the
entries that were added since the last batch, by file, at most ``filesPerTrigger`` of them
a batch: an incremental listing whose offset is the last file seen.

``walk`` goes down level by level. What it has seen is a table in the shared folder, and a
level is what the last one's folders hold less what was seen, so a folder that is its own
ancestor is walked once, and neither the number of rows nor the depth is limited by a
recursive query. Depths are the least.

Defined results: null children are left out; an entry with several parents has its least
depth; roots without children are walked alone; an empty table gives the roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpusforge.session import fresh_path

PAGE_SIZE, FILES = 1000, 100


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str, after: str = "") -> list[str]:
    """Names of the table's files after a name, in order; files are added with growing names."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    found = [f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_"))]
    return sorted(n for n in found if n > after)


def _pages(path: str, columns: list[str], size: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(place) as f:
        yield from pq.ParquetFile(f).iter_batches(batch_size=size, columns=columns)


class FolderReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.path, self.size = [f.name for f in schema.fields], options["path"].rstrip("/"), int(options.get("pageSize", PAGE_SIZE))

    def partitions(self):
        return [FilePartition(f"{self.path}/{n}") for n in _files(self.path)] or [FilePartition("")]

    def read(self, partition):
        if partition.path:
            yield from _pages(partition.path, self.columns, self.size)


class FolderStreamReader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.columns, self.path, self.size = [f.name for f in schema.fields], options["path"].rstrip("/"), int(options.get("pageSize", PAGE_SIZE))
        self.most, self.last = int(options.get("filesPerTrigger", FILES)), None

    def initialOffset(self):  # noqa: N802
        return {"file": ""}

    def latestOffset(self):  # noqa: N802
        found = _files(self.path, self.last or "")[: self.most]
        self.last = found[-1] if found else self.last or ""
        return {"file": self.last}

    def partitions(self, start, end):
        self.last = max(self.last or "", end["file"])  # after a restart, go on from what was planned
        return [FilePartition(f"{self.path}/{n}") for n in _files(self.path, start["file"]) if n <= end["file"]]

    def read(self, partition):
        yield from _pages(partition.path, self.columns, self.size)


class PagedFolders(DataSource):
    """``spark.read.format("paged_folders").load(path)``, or ``readStream``."""

    @classmethod
    def name(cls):
        return "paged_folders"

    def schema(self):
        return "parent string, child string, is_folder boolean, seq long"

    def reader(self, schema):
        return FolderReader(schema, self.options)

    def streamReader(self, schema):  # noqa: N802
        return FolderStreamReader(schema, self.options)


def walk(edges: DataFrame, roots: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(id, depth) of all that is below the roots (one column), themselves included.

    edges: parent, child; those whose child is known to be a file cost nothing more. The
    driver only learns whether a level is empty.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "walk")
    spark_schema = f"id {dict(edges.dtypes)['child']}, depth long"
    pairs = edges.select(F.col("parent").alias("id"), "child").filter("id IS NOT NULL AND child IS NOT NULL")
    level = roots.select(F.col(roots.columns[0]).alias("id")).distinct().withColumn("depth", F.lit(0).cast("long"))
    depth = 0
    while True:
        level.write.parquet(f"{path}/level-{depth:06d}")
        last = spark.read.schema(spark_schema).parquet(f"{path}/level-{depth:06d}")
        if last.isEmpty() or depth == most_levels:
            break
        depth += 1
        seen = spark.read.schema(spark_schema).parquet(*[f"{path}/level-{d:06d}" for d in range(depth)])
        below = pairs.join(last.select("id"), "id", "left_semi").select(F.col("child").alias("id")).distinct()
        level = below.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
    return spark.read.schema(spark_schema).parquet(*[f"{path}/level-{d:06d}" for d in range(depth + 1)])
