"""Document fingerprints: one-permutation MinHash with optimal densification.

The hashes of a text's distinct five-word shingles are placed once: the top bits
choose one of 256 bins, the rest is the value, and a bin keeps its least value.
An empty bin takes over a full one that hashes of (bin, attempt) find, alike for
all texts. Of each value the low 8 bits are kept, and likeness corrects for the
1 in 256 chance that those agree by accident.

Defined results: a null or empty text, or one without words, has an empty
fingerprint, which is like another empty one (1) and unlike all else (0); fewer
than five words are one shingle; equal texts have equal fingerprints. Documents
of one id follow one another by their texts; null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm import common

BINS, BITS = 256, 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: (attempt, bin): the bins that an empty bin tries, in this order.
_TRIES = (common.mix(np.arange(1, 64 * BINS + 1, dtype=np.uint64)) >> np.uint64(64 - 8)).astype(np.int64).reshape(64, BINS)


def _densify(bins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a full one."""
    full = bins != _NONE
    todo = ~full & full.any(axis=1, keepdims=True)
    out = bins.copy()
    for tries in _TRIES:
        if not todo.any():
            return out
        hit = todo & full[:, tries]
        rows, cols = np.nonzero(hit)
        out[rows, cols] = bins[rows, tries[cols]]
        todo &= ~hit
    for r, c in zip(*np.nonzero(todo), strict=True):  # what 64 attempts left: the next full bin around
        out[r, c] = bins[r, (c + np.flatnonzero(np.roll(full[r], -c))[0]) % BINS]
    return out


def sketch(texts: list[bytes]) -> list[bytes]:
    """The packed fingerprint of each text; empty where it has no words."""
    bins = np.full((len(texts), BINS), _NONE, np.uint64)
    hashes, rows, _ = common.shingles_of(texts, common.SPACE_WORDS)
    np.minimum.at(bins.reshape(-1), rows * BINS + (hashes >> np.uint64(56)).astype(np.int64), hashes & np.uint64((1 << 56) - 1))
    used = (bins != _NONE).any(axis=1)
    packed = (_densify(bins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return [p.tobytes() if u else b"" for p, u in zip(packed, used.tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard likeness; agreement by chance is taken off."""
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / BINS
    chance = 2.0**-BITS
    return min(1.0, max(0.0, float(same - chance) / (1 - chance)))


def likeness_column(a: str, b: str) -> Column:
    """The same of two columns of hexadecimal fingerprints."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + (F.substring(F.col(a), 2 * i + 1, F.lit(2)) == F.substring(F.col(b), 2 * i + 1, F.lit(2))).cast("int"))
    value = (same / BINS - 2.0**-BITS) / (1 - 2.0**-BITS)
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``fingerprint``: 256 bytes in hexadecimal."""
    return common.map_text(df, text, keep, [("fingerprint", T.StringType())], lambda: lambda texts: [[x.hex() for x in sketch(texts)]])


def with_next(df: DataFrame, fn, schema: str, key: str = "doc_id") -> DataFrame:
    """Stream the rows in order of ``key`` past ``fn``, each with the one after it.

    Rows are dealt into buckets by ranges of the key, and each bucket also gets
    the first row of the bucket after it (the last one: the very first row), so
    texts are shuffled once and no window spans all rows. ``fn`` takes an iterator
    of (key, text, ends) where a true ``ends`` marks the last row of a bucket,
    which only serves as the next of the one before.
    """
    ranges = common.Ranges(df, key, common.partitions(df.sparkSession))
    rows = df.select(F.col(key).cast("long").alias("k"), common.text_or_empty().alias("t"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            b = ranges.bucket(keys)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.zeros(len(b), bool)), *batch.columns], names=["b", "halo", "k", "t"])
            first = np.where(b > 0, ranges.starts[b - 1], 0 if ranges.head is None else ranges.head) if len(ranges.starts) else np.full(len(b), ranges.head or 0)
            known = np.asarray(pc.is_valid(keys))
            head = np.where((b == 0) & (ranges.head is None), ~known, known & (np.asarray(pc.fill_null(keys, 0)) == first))
            if head.any():
                some = batch.filter(pa.array(head))
                to = ((b[head] - 1) % ranges.count).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(to), bool)), *some.columns], names=["b", "halo", "k", "t"])

    dealt = common.map_arrow(rows, deal, "b int, halo boolean, k long, t string")
    ordered = common.by_bucket(dealt, "b", ranges.count).sortWithinPartitions("b", "halo", F.asc_nulls_first("k"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            ended = None
            for batch in batches:
                for b, halo, k, t in zip(*(batch.column(i) for i in range(4)), strict=True):
                    if halo.as_py():
                        if ended == b.as_py():
                            continue
                        ended = b.as_py()
                    yield k.as_py(), t.as_py(), halo.as_py()

        yield from fn(stream())

    return common.map_arrow(ordered, run, schema)


OP4_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OP4_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _op4_rows(stream) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rows, their edited texts and the next rows, slice by slice."""

    def finish(group):
        texts = [t.encode() for _, t, _ in group]
        prints = sketch(texts)
        edited = []
        for (_, t, ends), (_, following, _) in zip(group, group[1:], strict=False):
            cut = 0 if ends else len(t) // 4
            edited.append((t[: len(t) - cut] + following[:cut]).encode() if not ends else b"")
        edited_prints = sketch(edited) if edited else []
        out = []
        for i, e in enumerate(edited):
            k, t, ends = group[i]
            if not ends:
                f, g = prints[i], edited_prints[i]
                out.append((k, len(t), hashlib.sha256(e).hexdigest(), f.hex(), g.hex(), likeness(f, g), likeness(f, prints[i + 1])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OP4_ARROW, strict=True)], schema=_OP4_ARROW) if out else None

    group, size = [], 0
    for row in stream:
        group.append(row)
        size += len(row[1])
        if size >= common.SLICE_BYTES // 2 and len(group) > 1:
            if (done := finish(group)) is not None:
                yield done
            group, size = [group[-1]], len(group[-1][1])
    if group and (done := finish(group)) is not None:
        yield done


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), _op4_rows, OP4_SCHEMA)
