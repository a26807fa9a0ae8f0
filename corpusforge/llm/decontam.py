"""Benchmark decontamination with one Aho-Corasick automaton over all windows.

A window is 10 consecutive words of an item, or a whole shorter item. All
windows go into one automaton; each text is normalised and read once, and the
places are mapped back to the text's own characters. Windows are broadcast in
blocks of a checked size: a benchmark within one block is scanned for in one
pass, a larger one in as many passes as it has blocks, merged by the text.

Defined results: null and empty texts have no words, hits or items; an item
without words has no window; repeated items count once for each item id; a null
item id stands as the string ``null``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm import common

WINDOW = 10
#: Window text that one automaton holds at most.
BLOCK_BYTES = 8 << 20

#: First and past-the-last word, and the same stretch in the text's characters.
_PLACES = ("start", "end", "char_start", "char_end")
_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in _PLACES])
_FOUND = T.StructType([
    T.StructField("words", T.LongType()),
    T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows, with the ids of the items that hold them."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), common.text_or_empty().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.translate(common.ALNUM_WORDS).split()
                found = list({b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else ())
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    return common.map_arrow(rows, run, "item string, window binary").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def block_count(table: DataFrame, limit: int = BLOCK_BYTES) -> int:
    """How many blocks of at most about ``limit`` bytes the windows take."""
    size = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i))
    total = table.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    return 1 if total <= limit else 2 * (total // limit + 1)


def block(table: DataFrame, part: int, parts: int) -> list[tuple[bytes, list[str]]]:
    """One block of the windows, dealt by hash."""
    some = table if parts == 1 else table.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
    return [(bytes(r["window"]), r["items"]) for r in some.collect()]


_BUILT: dict[int, object] = {}


def _automaton(shared):
    """The automaton of a broadcast block, built once in a worker."""
    import ahocorasick

    if shared not in _BUILT:
        _BUILT.clear()
        automaton = ahocorasick.Automaton()
        for window, items in shared.value:
            automaton.add_word(f" {window.decode('latin-1')} ", (len(window), items))
        automaton.make_automaton()
        _BUILT[shared] = automaton
    return _BUILT[shared]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan_text(automaton, data: bytes) -> dict:
    """Words, hit stretches in words and in characters, and the items that occur."""
    words = data.translate(common.ALNUM_WORDS).split()
    none = {"words": len(words), "spans": [], "items": []}
    if not len(automaton) or not words:
        return none
    joined = b" %b " % b" ".join(words)
    hits = [(end, value) for end, value in automaton.iter(joined.decode("latin-1"))]
    if not hits:
        return none
    # a word's number is that of the space before it
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in hits])
    starts = np.searchsorted(spaces, [e - size - 1 for e, (size, _) in hits])
    stretches = _merged(list(zip(starts.tolist(), ends.tolist(), strict=True)))
    is_word = np.frombuffer(data.translate(common.ALNUM_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    char = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return none | {
        "spans": [dict(zip(_PLACES, (a, b, int(char[edge[2 * a]]), int(char[edge[2 * b - 1]])), strict=True)) for a, b in stretches],
        "items": sorted({i for _, (_, items) in hits for i in items}),
    }


def _scan(df: DataFrame, text: str, keep: list[str] | None, held: list) -> DataFrame:
    """``keep`` and ``hits`` of one block of windows."""
    shared = df.sparkSession.sparkContext.broadcast(held)  # within block_bytes

    def make():
        automaton = _automaton(shared)
        return lambda texts: [[scan_text(automaton, t) for t in texts]]

    return common.map_text(df, text, keep, [("hits", _FOUND)], make)


def _spans_union(spans):
    """Sorted stretches that touch or overlap, as one each."""
    none = F.expr("array()").cast(T.ArrayType(_SPAN))

    def add(done, s):
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["char_start"].alias("char_start"), F.greatest(last["char_end"], s["char_end"]).alias("char_end"))
        joins = F.coalesce(F.try_element_at(done, F.lit(-1))["end"] >= s["start"], F.lit(False))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, add)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` (all columns by default) and ``hits``: words, spans, items."""
    table = common.materialise(windows(benchmark, size), "windows")
    parts = block_count(table, block_bytes)
    if parts == 1:
        return _scan(df, text, keep, block(table, 0, 1))
    # what a text holds depends on it alone: passes meet at its hash
    hashed = F.sha2(common.text_or_empty(text), 256)
    texts = df.select(hashed.alias("_blob"), F.col(text).alias("_value"))
    union = None
    for part in range(parts):  # the driver holds one block at a time
        found = _scan(texts, "_value", ["_blob"], block(table, part, parts)).select("_blob", "hits.*")
        union = found if union is None else union.unionByName(found)
    kept = df.select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    name = common.free_name(kept, "hits")
    merged = union.groupBy("_blob").agg(
        F.struct(
            F.first("words").alias("words"),
            _spans_union(F.flatten(F.collect_set("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        ).alias("_found"),
    )
    rows = df.select(hashed.alias("_of"), F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_whole"))
    return rows.join(merged, rows["_of"] == merged["_blob"]).select("_whole.*", F.col("_found").alias(name))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, bench, keep=["doc_id"])
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("hits.words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
