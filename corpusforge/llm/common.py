"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusforge.session import shared_dir, ship

#: Text that one vectorised step works on; it bounds a task's working memory.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch where ``spark.sql.execution.arrow.maxRecordsPerBatch`` is unset.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def _table(keep) -> bytes:
    """A translation that lower-cases A-Z and turns separators into spaces."""
    low = bytes(range(256)).translate(bytes.maketrans(_UPPER, _LOWER))
    return bytes(b if keep(b) else 32 for b in low)


#: Words are [0-9a-z] and everything outside ASCII.
ALNUM_WORDS = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Words are whatever stands between ASCII white space.
SPACE_WORDS = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a frame to the shared folder, or one in it, and read it back: later steps start there."""
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables that no frame reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text; a longer text stands alone."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0))
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def give_back() -> None:
    """Hand memory that this worker no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def map_arrow(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this package on the workers.

    Rows hold whole texts, so a batch has ``BATCH_ROWS`` of them unless the
    session says otherwise; a task gives its buffers back when it is done.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_text(df: DataFrame, text: str, keep: list[str] | None, more: list[tuple[str, T.DataType]], make: Callable[[], Callable]) -> DataFrame:
    """``keep`` (all columns by default) and a column for each of ``more``, made from texts.

    ``make`` is called in each task and gives a function from a list of texts in
    UTF-8 (null: empty) to a list of values for each new column; it sees about
    ``SLICE_BYTES`` at a time. A text that is kept travels once.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    names = [free_name(kept, n) for n, _ in more]
    inside = dict(kept.dtypes).get(text) in ("string", "binary")
    columns = [F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row")]
    rows = df.select(*columns, *([] if inside else [F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("_text")]))
    out = T.StructType([rows.schema["_row"], *(T.StructField(n, t) for n, (_, t) in zip(names, more, strict=True))])
    kinds = [to_arrow_type(t) for _, t in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            row = batch.column(0)
            texts = pc.fill_null(row.field(text).cast(pa.binary()), b"") if inside else batch.column(1)
            for a, b in slices(texts):
                made = fn(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=["_row", *names])

    return map_arrow(rows, run, out).select("_row.*", *names)


# --- word hashes -----------------------------------------------------------

_HASH_KEY = "corpusforge word"


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit SipHash values of words, which no structure within them makes collide."""
    return hash_array(np.asarray(words, dtype=object), hash_key=_HASH_KEY, categorize=False) if words else np.empty(0, np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, bytes]:
    """A hash for each word of translated text (spaces separate), and a digest of all words.

    A long text is worked on in steps, so that its words are never all held as objects.
    """
    out, digest, at = [np.empty(0, np.uint64)], hashlib.blake2b(digest_size=16), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        digest.update(b"".join([w + b" " for w in words]))
        out.append(hash_words(words))
        at = end
    return np.concatenate(out), digest.digest()


_SHINGLE = [np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the distinct runs of k words, sorted; all words as one where fewer."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            h = np.uint64(n)
            for i in range(n):
                h = mix(np.asarray([h * _SHINGLE[0] + words[i]]))[0]
            return np.asarray([h], np.uint64)
        h = words[: n - k + 1] * _SHINGLE[0]
        for i in range(1, k):
            h = mix(h) + words[i : n - k + 1 + i] * _SHINGLE[i % 5]
        return np.unique(mix(h))


def shingles_of(texts: list[bytes], table: bytes, k: int = 5) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle hashes of many texts, the text of each, and a digest of each text's words.

    Hashes are in the order of the texts and of places in them, repeats included.
    """
    read = [word_hashes(t.translate(table)) for t in texts]
    words, digests = [w for w, _ in read], [d for _, d in read]
    counts = np.asarray([len(w) for w in words], np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    parts, rows = [], []
    if len(flat) >= k:
        whole = np.flatnonzero(of[: len(of) - k + 1] == of[k - 1 :])
        with np.errstate(over="ignore"):
            h = flat[whole] * _SHINGLE[0]
            for i in range(1, k):
                h = mix(h) + flat[whole + i] * _SHINGLE[i % 5]
            parts.append(mix(h))
        rows.append(of[whole])
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        parts.append(shingle_hashes(words[i], k))
        rows.append(np.asarray([i]))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), digests
    h, rows = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return h[order], rows[order], digests


# --- order by key over many tasks ------------------------------------------


class Ranges:
    """Ranges that cut a column of whole numbers into about equal buckets.

    ``starts`` holds the least key of each bucket but the first; each is a key of
    the table, so no bucket is empty. There is one number for each partition, so the
    list doesn't grow with the rows; tasks look keys up in it by bisection.
    """

    def __init__(self, df: DataFrame, key: str, buckets: int):
        at = [i / buckets for i in range(1, buckets)] or [0.5]
        found = df.select(F.min(key).alias("least"), F.count_if(F.col(key).isNull()).alias("nulls"), F.percentile_approx(key, at, 10 * buckets).alias("at")).first()
        keys = sorted(set(found["at"] or [])) if buckets > 1 else []
        if found["nulls"] == 0:
            keys = [k for k in keys if k > found["least"]]
        self.head = None if found["nulls"] else found["least"]
        self.starts = np.asarray(keys, np.int64)

    @property
    def count(self) -> int:
        return len(self.starts) + 1

    def bucket(self, keys: pa.Array) -> np.ndarray:
        """The bucket of each key; null keys come first."""
        known = np.asarray(pc.is_valid(keys))
        found = np.searchsorted(self.starts, np.asarray(pc.fill_null(keys, 0)), side="right")
        return np.where(known, found, 0).astype(np.int32)


def by_bucket(df: DataFrame, bucket: str, buckets: int) -> DataFrame:
    """One partition for each value 0..buckets-1 of ``bucket``."""
    return df.repartitionById(buckets, F.col(bucket).cast("int"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
