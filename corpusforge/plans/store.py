"""A versioned store of tables in buckets: a change writes only the buckets that it touches.

Each table is cut by hash of its key into a fixed number of buckets. A version is one
small manifest that names, for every table, the folder that each bucket stands in; a
change writes the new contents of its buckets beside the old ones, in a folder of its own,
and then the next manifest, put in place by one rename. Several tables change together
that way. A job that is lost before the rename changes nothing, readers of a version are
never disturbed, and of two writers that start from one version the second fails.
``vacuum`` removes what no kept manifest names.

A table can also be a log: rows that are appended, a folder a change, and folded elsewhere.

Rows whose key is null are in bucket 0 and are replaced by rows with a null key. Keys that
many rows have are spread over several files of their bucket.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the version that this change wanted to make."""


@dataclass
class Table:
    """Where a table's rows are, as a manifest has it."""

    key: str | None  # None: a log
    schema: str
    buckets: int = BUCKETS
    folders: dict[str, str] = field(default_factory=dict)  # of each bucket
    parts: list[str] = field(default_factory=list)  # of a log


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        place = self._at(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    # --- versions ------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("manifests") if n.isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The newest version's, or a given one's; an empty store has version 0."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "batches": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{version:012d}", wholetext=True).first()[0]
        found = json.loads(text)
        return found | {"tables": {name: Table(**t) for name, t in found["tables"].items()}}

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table's rows, of all buckets or some; none where the version has no such table."""
        table = self.manifest(version)["tables"].get(name)
        return None if table is None else self._rows(table, buckets)

    def _rows(self, table: Table, buckets: list[int] | None = None) -> DataFrame:
        wanted = table.parts if table.key is None else [f"{f}/bucket={b}" for b, f in sorted(table.folders.items()) if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*[f"{self.path}/data/{w}" for w in wanted])

    def buckets_of(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that keys (one column) are in; at most as many as there are buckets."""
        table = self.manifest()["tables"][name]
        return [r[0] for r in keys.select(bucket(keys.columns[0], table.buckets)).distinct().collect()]

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys (one column); other buckets aren't read."""
        table = self.manifest()["tables"][name]
        rows = self._rows(table, self.buckets_of(name, keys))
        return rows.join(keys.select(F.col(keys.columns[0]).alias("_key")).distinct(), F.col(table.key).eqNullSafe(F.col("_key")), "left_semi")

    def change(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the newest manifests and what they don't name; no writer may be at work."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        used = {f for v in kept for t in self.manifest(v)["tables"].values() for f in [*t.folders.values(), *t.parts]}
        for v in old:
            self._fs.delete(self._at("manifests", f"{v:012d}"), False)
        dead = [n for n in self._names("data") if n not in used]
        for n in dead:
            self._fs.delete(self._at("data", n), True)
        return dead


def bucket(key: str, buckets: int):
    return F.when(F.col(key).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets))).cast("int")


class Change:
    """What the next version has anew; ``commit`` makes it.

    Reads within a change see the version that it started from.
    """

    def __init__(self, store: Store):
        self.store = store
        self.base = store.manifest()
        self.tables: dict[str, Table] = dict(self.base["tables"])
        self.figures: dict[str, int] = {}

    def _write(self, rows: DataFrame, by_bucket: bool) -> str:
        folder = uuid.uuid4().hex
        if by_bucket:
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.store.path}/data/{folder}")
        else:
            rows.write.parquet(f"{self.store.path}/data/{folder}")
        return folder

    def rows(self, name: str) -> DataFrame | None:
        return self.store._rows(self.tables[name]) if name in self.tables else None

    def _replace(self, name: str, key: str, new: DataFrame | None, gone: DataFrame, buckets: int, keep: bool = False) -> Change:
        old = self.tables.get(name)
        if old is not None and old.key != key:
            raise ValueError(f"{name} is kept by {old.key}")
        buckets = old.buckets if old else buckets
        gone = gone.select(F.col(gone.columns[0]).alias("_key")).distinct()
        touched = [r[0] for r in gone.select(bucket("_key", buckets)).distinct().collect()]  # buckets, not rows
        kept = None
        if old is not None:
            before = self.store._rows(old, touched)
            kept = before if keep else before.join(gone, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        rows = kept if new is None else new if kept is None else kept.unionByName(new, allowMissingColumns=True)
        if rows is None:
            return self
        schema = rows.schema
        folder = self._write(rows.withColumn("bucket", bucket(key, buckets)), True)
        made = {n.removeprefix("bucket=") for n in self.store._names("data", folder) if n.startswith("bucket=")}
        folders = {b: f for b, f in (old.folders if old else {}).items() if int(b) not in touched}
        self.tables[name] = Table(key, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), buckets, folders | dict.fromkeys(made, folder))
        self.figures[f"{name} buckets"] = len(touched)
        return self

    def upsert(self, name: str, new: DataFrame, key: str, buckets: int = BUCKETS) -> Change:
        """All rows of the keys that ``new`` has are replaced by its own."""
        folder = self._write(new, False)  # once, as it is read twice
        new = self.store.spark.read.schema(new.schema).parquet(f"{self.store.path}/data/{folder}")
        return self._replace(name, key, new, new.select(key), buckets)

    def add(self, name: str, new: DataFrame, key: str, buckets: int = BUCKETS) -> Change:
        """Rows besides those that are there; ``new`` is read twice and should be stored."""
        return self._replace(name, key, new, new.select(key), buckets, keep=True)

    def delete(self, name: str, keys: DataFrame) -> Change:
        """No row of these keys (one column) is left; how many went is in ``figures``."""
        if name not in self.tables:
            return self
        table = self.tables[name]
        before = self.store._rows(table, self.store.buckets_of(name, keys) if name in self.base["tables"] else None)
        went = before.join(keys.select(F.col(keys.columns[0]).alias("_key")).distinct(), F.col(table.key).eqNullSafe(F.col("_key")), "left_semi").count()
        self.figures[f"{name} rows"] = went
        return self._replace(name, table.key, None, keys, table.buckets) if went else self

    def append(self, name: str, rows: DataFrame) -> Change:
        """Rows at the end of a log."""
        old = self.tables.get(name)
        folder = self._write(rows, False)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.tables[name] = Table(None, schema, 0, {}, [*(old.parts if old else []), folder])
        return self

    def clear(self, name: str) -> Change:
        """A table without rows."""
        if name in self.tables:
            old = self.tables[name]
            self.tables[name] = Table(old.key, old.schema, old.buckets)
        return self

    def commit(self, stream: str | None = None, batch: int | None = None) -> int:
        """Make the next version; ``stream`` and ``batch`` note a micro-batch as done."""
        fs, version = self.store._fs, self.base["version"] + 1
        batches = self.base["batches"] | ({stream: batch} if stream else {})
        text = json.dumps({"version": version, "tables": {n: t.__dict__ for n, t in self.tables.items()}, "batches": batches})
        draft, place = self.store._at("drafts", uuid.uuid4().hex), self.store._at("manifests", f"{version:012d}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.store.path} exists")
        return version


def remove_files(store: Store, files: DataFrame, tables: dict[str, str]) -> dict[str, int]:
    """One version without these files (file_id) in any of the tables, and how many rows each lost.

    ``tables`` names each table's key column; a table kept by another key, such as
    provenance, has its own removal.
    """
    change = store.change()
    for name, key in tables.items():
        if name in change.tables and change.tables[name].key == key:
            change.delete(name, files)
    if change.tables != change.base["tables"]:
        change.commit()
    return {k.removesuffix(" rows"): n for k, n in change.figures.items() if k.endswith(" rows")}
