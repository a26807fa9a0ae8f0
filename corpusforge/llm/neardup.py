"""Near-duplicate groups: fast similarity sketching, banding, exact verification.

Sketch: in round i every shingle is hashed into a bin of 125, and a bin that was
empty so far keeps its least hash; after 125 such rounds, round 125 + j sends all
shingles to bin j, so every bin fills. Large sets need one or two rounds. 25 bands
of 5 bins find a pair of likeness 0.85 but for a chance of 4e-7, and one of 0.80
but for 5e-5.

Texts of equal words are one class, so copies never make pairs. Nor does a bucket
of a band form all its pairs: its classes are compared with a hub, the class with
the smallest share of shingles that no other candidate has. Those near the hub
(0.7 for a threshold of 0.85) are settled by it, the rest of the bucket gets another
hub, three times in all, and links grow to components. What is left are pairs of
different components: those of classes that no hub settled, and those of which one is
settled by a hub h that the other is within 0.55 of, as 1 - likeness is a metric.
If x and y hold i and j shingles of h and share e others, they share at most
min(i, j) + e; so they are found by a range of (i, j) alone, or by the shingles
outside of h that both have, and the bound must reach the threshold before their
full sets are compared. No link is dropped by any of these steps.

Words are told apart by keyed 64-bit hashes, and classes by 128-bit digests of all
their words. Keys with many links are dealt over several tasks.

Defined results: a text without words is linked with nothing, not even with
another such; fewer than five words are one shingle; null ids give a null
component; rows that repeat an id each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import common

COORDINATES, ROWS = 125, 5
THRESHOLD = (85, 100)
#: Likeness to a hub that makes a class one of the hub's members; ``settling`` follows from it.
MEMBER = (55, 100)
#: Hubs of one bucket before the pairs of different components are formed of what is left.
ROUNDS = 3
#: Links of one node, or rows of one label, that a task joins.
SPREAD = 1000

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = common.mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fast_sketch(hashes: np.ndarray, rows: np.ndarray, n: int, t: int = COORDINATES) -> np.ndarray:
    """The sketches (n, t) of n sets given as (hash, set) pairs; a set without pairs stays unfilled."""
    out = np.full(n * t, _NONE, np.uint64)
    for i in range(2 * t):
        if not len(hashes):
            break
        x = common.mix(hashes ^ _SEEDS[i])
        if i < t:
            at = rows * t + (((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
        else:
            at = rows * t + (i - t)
        empty = out[at] == _NONE
        np.minimum.at(out, at[empty], common.mix(x[empty]))
        done = (out.reshape(n, t) != _NONE).all(axis=1)
        if done.any():
            left = ~done[rows]
            hashes, rows = hashes[left], rows[left]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, r: int = ROWS) -> np.ndarray:
    """One 64-bit key for each sketch and band."""
    n, t = sketches.shape
    grouped = sketches.reshape(n, t // r, r)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(_SEEDS[: t // r], (n, t // r)).copy()
        for j in range(r):
            key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return key


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, spot, text) to (doc_id, spot, class, n, bands)."""
    for batch in batches:
        for a, b in common.slices(batch.column(2)):
            hashes, rows, digests = common.shingles_of(batch.column(2).slice(a, b - a).to_pylist(), common.SPACE_WORDS)
            cuts = np.searchsorted(rows, np.arange(1, b - a))
            sizes = [len(np.unique(part)) for part in np.split(hashes, cuts)]
            keys = band_keys(fast_sketch(hashes, rows, b - a)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([d if n else None for d, n in zip(digests, sizes, strict=True)], pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array([k.tolist() if n else [] for k, n in zip(keys, sizes, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "spot", "class", "n", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, class, text) to (id, s): the set of each text that is of the class, once where rows follow one another."""
    last = None
    for batch in batches:
        for a, b in common.slices(batch.column(2)):
            hashes, rows, digests = common.shingles_of(batch.column(2).slice(a, b - a).to_pylist(), common.SPACE_WORDS)
            parts = np.split(hashes, np.searchsorted(rows, np.arange(1, b - a)))
            ids, sets = [], []
            for i, wanted, digest, part in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), digests, parts, strict=True):
                if digest == wanted and i != last:
                    last = i
                    ids.append(i)
                    sets.append(np.unique(part).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])


def spread_join(rows: DataFrame, key: str, salt: str, labels: DataFrame, folder: str) -> DataFrame:
    """``rows`` joined with the one row of ``labels`` (key, ...) of each key.

    Rows of a key that has more than ``SPREAD`` are dealt by ``salt`` over parts, and
    its row of ``labels`` is given to each part.
    """
    hot = common.materialise(rows.groupBy(key).agg(F.count("*").alias("c")).filter(F.col("c") > SPREAD).select(key, F.expr(f"CAST(c DIV {SPREAD} + 1 AS int)").alias("parts")), "hot", folder)
    if hot.isEmpty():
        return rows.join(labels, key)
    dealt = rows.join(hot, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(salt), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = labels.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [key, "part"]).drop("part")


def components(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(id, label): the least id that edges (a, b) reach from each node.

    Labels fall to the least of the neighbours' and jump along labels; every round
    is written to the shared folder. The driver only learns whether one changed.
    """
    both = common.materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", folder)
    labels = common.materialise(nodes.select("id", F.col("id").alias("label")), "labels", folder)
    while True:
        near = spread_join(both, "b", "a", labels.withColumnRenamed("id", "b"), folder).groupBy("a").agg(F.min("label").alias("m"))
        least = common.materialise(labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("label", F.coalesce("m", "label")).alias("next"), F.col("label").alias("was")), "labels", folder)
        up = least.select(F.col("id").alias("next"), F.col("next").alias("label"))
        labels = common.materialise(spread_join(least, "next", "id", up, folder).select("id", "label", (F.col("label") != F.col("was")).alias("moved")), "labels", folder)
        if labels.filter("moved").isEmpty():
            return labels.select("id", "label")
        labels = labels.select("id", "label")


def _can_match(a: str, b: str, q: tuple[int, int]):
    """Sizes and own shingles leave room for the likeness.

    A class of n shingles, u of them its own, has no partner of more than
    (n - u) / 0.85 - u shingles: that is ``cap``.
    """
    n, cap = (lambda x: F.col(f"{x}.n")), (lambda x: F.col(f"{x}.cap"))
    return (n(a) <= cap(b)) & (n(b) <= cap(a)) & (n(a) * q[1] >= n(b) * q[0]) & (n(b) * q[1] >= n(a) * q[0])


def _reaches(shared, n, m, q: tuple[int, int]):
    """Whether sets of n and m with so many shared shingles are as alike as q."""
    return shared * (q[0] + q[1]) >= (n + m) * q[0]


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m, i): sizes of both full sets and of what they share."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    whole = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    size = lambda c: F.size(c).cast("long")
    return whole.select("a", "b", size("sa").alias("n"), size("sb").alias("m"), size(F.array_intersect("sa", "sb")).alias("i"))


def _remaining(settled: DataFrame, members: DataFrame, open_: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, q: tuple[int, int], folder: str) -> DataFrame:
    """Pairs (a, b) of different components that may still be alike enough."""
    known = common.materialise(nodes.join(labels, "id"), "known", folder)
    place = lambda t, name: common.materialise(t.join(known, "id").select("hub", "id", "i", "n", "cap", "label"), name, folder)
    x, y = place(settled, "settled"), place(members, "members")
    apart = (F.col("x.label") != F.col("y.label")) & _can_match("x", "y", q)
    least, sizes = F.least("x.i", "y.i"), (F.col("x.n"), F.col("y.n"))
    ends = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]

    within = x.alias("x").join(y.alias("y").hint("merge"), (F.col("x.hub") == F.col("y.hub")) & apart & _reaches(least, *sizes, q)).select(*ends)

    # shingles outside of the hub that a class settled by it shares with another member
    hub_sets = sets.select(F.col("id").alias("hub"), F.col("s").alias("hs"))
    outside = lambda t: t.join(sets.hint("merge"), "id").join(hub_sets.hint("merge"), "hub").select("hub", F.explode(F.array_except("s", "hs")).alias("h"), "id", "i", "n", "cap", "label")
    one, two = common.materialise(outside(x), "outside", folder), common.materialise(outside(y), "outside", folder)
    also = one.alias("x").join(two.alias("y").hint("merge"), (F.col("x.hub") == F.col("y.hub")) & (F.col("x.h") == F.col("y.h")) & apart)
    counted = also.groupBy(F.col("x.hub"), *ends, least.alias("least"), (sizes[0] + sizes[1]).alias("sizes")).agg(F.countDistinct("x.h").alias("e"))
    beyond = counted.filter(_reaches(F.col("least") + F.col("e"), F.col("sizes"), F.lit(0), q)).select("a", "b")

    last = common.materialise(open_.join(known.select("id", "label"), "id").select("key", "id", "n", "cap", "label"), "last", folder)
    alone = last.alias("x").join(last.alias("y").hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & apart).select(*ends)
    return common.materialise(within.union(beyond).union(alone).distinct(), "pairs", folder)


def _with_hub(open_: DataFrame, folder: str) -> DataFrame:
    """Open rows with the hub of their bucket; rows that are alone in theirs are left out."""
    hubs = open_.groupBy("key").agg(F.min(F.struct("share", "id")).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("hub.id").alias("hub"))
    return common.materialise(open_.join(common.materialise(hubs, "hubs", folder), "key"), "faced", folder)


def settling(threshold: tuple[int, int]) -> tuple[int, int]:
    """Likeness to a hub that settles a class: 1 - MEMBER = (1 - settling) + (1 - threshold)."""
    num, den = threshold
    return den * (MEMBER[0] + MEMBER[1]) - MEMBER[1] * num, MEMBER[1] * den


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    num, den = threshold
    settled = settling(threshold)
    folder = common.fresh_path(df.sparkSession, "near_duplicates")
    save = lambda frame, name: common.materialise(frame, name, folder)
    # where a text is found again: by its id, or by itself where it has none
    spot = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.sha2(common.text_or_empty(text), 256)))
    texts = df.select(F.col(key).cast("long").alias("doc_id"), spot.alias("spot"), common.text_or_empty(text).cast("binary").alias("text"))
    rows = save(common.map_arrow(texts, _classes, "doc_id long, spot string, class binary, n long, bands array<long>"), "rows")
    classes = rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("spot").alias("spot"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    # classes that share a bucket with another, and their sets
    keys = classes.select("id", F.explode("bands").alias("key"))
    shared = save(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "buckets")
    members = save(keys.join(shared.hint("merge"), "key"), "inside")
    candidates = save(members.select("id").distinct().join(classes.select("id", "class", "spot", "n"), "id"), "candidates")
    found = texts.join(candidates.hint("merge"), "spot").select("id", "class", "text")
    sets = save(common.map_arrow(found, _sets, "id long, s array<long>"), "sets")

    # shingles of one candidate alone are in no intersection
    own = sets.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other").groupBy("id").agg(F.count("*").alias("u"))
    sized = candidates.select("id", "n").join(own, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u"))
    sized = sized.select("id", "n", (F.col("u") / F.col("n")).alias("share"), F.expr(f"CAST((n - u) * {den} / {num} - u AS bigint)").alias("cap"))
    nodes = save(sized.filter(F.col("cap") * den >= F.col("n") * num), "nodes")

    open_ = save(members.join(nodes, "id"), "open")
    compared = []
    for _ in range(ROUNDS):
        faced = _with_hub(open_, folder)
        pairs = save(faced.filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
        sim = save(_shared(pairs, sets).distinct(), "compared")
        compared.append(sim)
        near = sim.filter(_reaches(F.col("i"), F.col("n"), F.col("m"), settled)).select(F.col("a").alias("id"), F.col("b").alias("hub"))
        open_ = save(faced.filter("id != hub").join(near, ["id", "hub"], "left_anti").drop("hub"), "open")

    each = compared[0]
    for sim in compared[1:]:
        each = each.union(sim)
    each = save(each.distinct(), "compared")
    alike = lambda q: _reaches(F.col("i"), F.col("n"), F.col("m"), q)
    edges = each.filter(alike(threshold)).select("a", "b")
    labels = components(nodes, edges, folder)
    of_hub = lambda q: each.filter(alike(q)).select(F.col("a").alias("id"), F.col("b").alias("hub"), "i")
    rest = _remaining(of_hub(settled), of_hub(MEMBER), open_, nodes, labels, sets, threshold, folder)
    more = save(_shared(rest, sets).filter(alike(threshold)).select("a", "b"), "links")
    if not more.isEmpty():
        labels = components(nodes, edges.union(more), folder)

    # components in terms of the rows' own ids
    named = save(classes.select("id", "class", "rep").join(labels, "id", "left").select("class", "rep", F.coalesce("label", "id").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = save(spread_join(named, "label", "class", least, folder).select("class", "component_id"), "of_class")
    out = rows.select("doc_id", "class", F.col("n").alias("n_shingles")).join(of_class, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    done = common.materialise(result, "near_duplicate_rows")
    common.remove(df.sparkSession, folder)
    return done


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
