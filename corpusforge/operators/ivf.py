"""An inverted-file index over embeddings: cells, probing, and exact search by bounds.

A coarse quantiser cuts the points into cells; each cell is a partition of a Parquet
table, so that a search reads only the cells that it probes. A search takes its queries
in blocks, scores a cell's points with the queries that probe it as one product of
matrices, keeps the best of each query in every task, and lets windows pick the best of
all tasks: pairs of points and queries are never shuffled.

Approximate search probes the cells whose centres are nearest; ``probes_for`` says how
many a wanted recall takes. Exact search goes on: the k-th score found so far is a bound
for each query, and what a cell can score at most follows from the angle to its centre
less the widest angle within it, so only cells that may still hold a better point are
read. Both give the scores of ``dense_channel``.

Defined results: points without an embedding are in no cell and are never found; zero
embeddings are in the first cell and score 0; ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import embeddings
from corpusforge.operators import nearest
from corpusforge.operators.search import BROADCAST_QUERIES, top_k

#: Cells at most, whatever the table, so that their centres fit every task.
MOST_CELLS = 4096
#: Points for each cell that the quantiser is fitted on, picked by hash of the id.
SAMPLE_PER_CELL = 64
#: Queries that the number of probes is measured with, picked by hash of the id.
TUNING_QUERIES = 256
#: Room for rounding when products of matrices stand in for sums in order.
ROOM = 1e-6
CELLS = "cell int, centre array<double>, n long, least double, length double"


@dataclass
class Index:
    """Where the cells are, and what is known of each; there are ``MOST_CELLS`` of them at most."""

    path: str
    centres: np.ndarray  # unit vectors
    counts: np.ndarray
    width: np.ndarray  # the widest angle of a point to its cell's centre
    length: np.ndarray  # the longest embedding of a cell

    def points(self, spark: SparkSession, cells=None) -> DataFrame:
        """(id, embedding, cell) of some cells, or all; others aren't read."""
        rows = spark.read.parquet(f"{self.path}/points")
        return rows if cells is None else rows.filter(F.col("cell").isin([int(c) for c in cells]))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1.0, size)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _cells_by_nearness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers of all cells for each row, the nearest centre first."""
    return np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")


def fit(points: DataFrame, cells: int, seed: int = 42) -> np.ndarray:
    """Unit centres by k-means over the different embeddings of a sample of about 64 points a cell."""
    from pyspark.ml.clustering import KMeans

    n = points.count()
    share = min(1.0, SAMPLE_PER_CELL * cells / max(n, 1))
    picked = points.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = picked.select(embeddings.features("embedding").alias("features")).distinct()
    few = rows.limit(cells + 1).collect()
    if len(few) <= cells:  # as many centres as there are embeddings
        return np.asarray(sorted(r["features"] for r in few)).reshape(len(few), -1)
    return _unit(np.asarray(KMeans(k=cells, seed=seed, maxIter=20).fit(rows).clusterCenters(), np.float64))


def build(points: DataFrame, path: str, cells: int | None = None, seed: int = 42) -> Index:
    """Write (id, embedding) by cell below ``path``; every point is indexed.

    The number of cells is the root of the number of points unless given. A large cell
    is spread over several files.
    """
    spark = points.sparkSession
    rows = points.filter(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    cells = min(MOST_CELLS, max(1, cells or round(n**0.5)))
    if n == 0:
        rows.withColumn("cell", F.lit(0)).write.parquet(f"{path}/points")
        spark.createDataFrame([], CELLS).write.parquet(f"{path}/cells")
        return load(spark, path)
    centres = fit(rows, cells, seed)
    kind = dict(rows.dtypes)["id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1), centres.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ centres.T).argmax(axis=1), pa.int32())], names=["id", "embedding", "cell"])

    placed = rows.mapInArrow(place, f"id {kind}, embedding array<double>, cell int")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/points")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, least, length = np.zeros(len(centres), np.int64), np.ones(len(centres)), np.zeros(len(centres))
        for batch in batches:
            x, cell = _matrix(batch.column(0), centres.shape[1]), np.asarray(batch.column(1))
            counts += np.bincount(cell, minlength=len(centres))
            np.minimum.at(least, cell, (_unit(x) * centres[cell]).sum(axis=1))
            np.maximum.at(length, cell, np.linalg.norm(x, axis=1))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(least[used]), pa.array(length[used])], names=["cell", "n", "least", "length"])

    stored = spark.read.parquet(f"{path}/points").select("embedding", "cell")
    figures = stored.mapInArrow(spread, "cell int, n long, least double, length double").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("length").alias("length"))
    known = {r["cell"]: r for r in figures.collect()}  # MOST_CELLS rows at most
    made = [(i, c.tolist(), known[i]["n"] if i in known else 0, known[i]["least"] if i in known else 1.0, known[i]["length"] if i in known else 0.0) for i, c in enumerate(centres)]
    spark.createDataFrame(made, CELLS).coalesce(1).write.parquet(f"{path}/cells")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
    least = np.asarray([r["least"] for r in rows])
    return Index(path, np.asarray([r["centre"] for r in rows]), np.asarray([r["n"] for r in rows]), np.arccos(np.clip(least, -1, 1)) + 1e-6, np.asarray([r["length"] for r in rows]))


@dataclass
class _Queries:
    """A block of queries, and which of them each cell is scored with."""

    ids: pa.Array
    vectors: np.ndarray
    of_cell: dict[int, np.ndarray]
    bound: np.ndarray  # scores below this aren't wanted

    @property
    def cells(self) -> list[int]:
        return sorted(c for c, q in self.of_cell.items() if len(q))


def _best(points: DataFrame, block: _Queries, k: int, digits: int, query_kind: str) -> DataFrame:
    """(query_id, id, score): the best k of each query in each task."""
    kind = dict(points.dtypes)["id"]
    shared = points.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = nearest.Best(q.bound, k)
        for batch in batches:
            x, cell = _matrix(batch.column(1), q.vectors.shape[1]), np.asarray(batch.column(2))
            for c in np.unique(cell):
                mine, at = q.of_cell.get(int(c), ()), np.flatnonzero(cell == c)
                if len(mine):
                    nearest.show(best, x[at], at, batch.column(0), q.vectors, mine, digits)
        yield from best.batches(q.ids)

    return points.select("id", "embedding", "cell").mapInArrow(run, f"query_id {query_kind}, id {kind}, score double")


def _blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and embeddings of the queries, about ``BROADCAST_QUERIES`` at a time."""
    q = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-q.count() // BROADCAST_QUERIES))
    for b in range(blocks):
        some = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        if len(some):
            vectors = some["embedding"].combine_chunks()
            yield some["query_id"].combine_chunks(), _matrix(vectors, len(vectors[0]))


def search(index: Index, queries: DataFrame, k: int = 150, probes: int | None = None, threshold: float = 0.05, digits: int = 6, within: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of each query (query_id, embedding).

    With ``probes``, points of that many cells whose centres are nearest; without, all
    points that an exact search finds. ``within`` (id) leaves other points out before
    any cut.
    """
    spark = queries.sparkSession
    kind = dict(queries.dtypes)["query_id"]
    cells = len(index.centres)
    id_kind = dict(index.points(spark).dtypes)["id"]
    found = [spark.createDataFrame([], f"query_id {kind}, id {id_kind}, score double")]

    def scan(block: _Queries) -> DataFrame:
        points = index.points(spark, block.cells)
        if within is not None:
            points = points.join(within.select("id"), "id", "left_semi")
        return _best(points, block, k, digits, kind)

    for ids, vectors in _blocks(queries) if cells else ():
        order = _cells_by_nearness(vectors, index.centres)
        first = min(cells, probes or max(1, round(cells**0.5)))
        near = {c: np.flatnonzero((order[:, :first] == c).any(axis=1)) for c in range(cells)}
        block = _Queries(ids, vectors, near, np.full(len(vectors), threshold))
        part = scan(block)
        if probes is None and first < cells:
            from corpusforge.operators.curation import checkpoint_table

            part = checkpoint_table(top_k(part, k, [F.desc("score"), F.asc("id")]).drop("rank"), "probed")
            kth = part.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select("query_id", "least").toArrow()  # a row for each query of the block
            bound = block.bound.copy()
            place = {i: n for n, i in enumerate(ids.to_pylist())}
            for i, least in zip(kth["query_id"].to_pylist(), kth["least"].to_pylist(), strict=True):
                bound[place[i]] = max(bound[place[i]], least)
            rest = _Queries(ids, vectors, _may_hold_better(index, vectors, bound, near), bound)
            if rest.cells:
                part = part.union(scan(rest))
        found.append(part)
    return top_k(reduce(DataFrame.union, found), k, [F.desc("score"), F.asc("id")])


def _may_hold_better(index: Index, vectors: np.ndarray, bound: np.ndarray, near: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Cells that aren't probed yet and may hold a point of at least each query's bound."""
    angle = np.arccos(np.clip(_unit(vectors) @ index.centres.T, -1, 1))
    top = np.linalg.norm(vectors, axis=1)[:, None] * index.length * np.cos(np.maximum(0, angle - index.width))
    # points at a right angle or beyond can score no more than 0, if short ones are among them
    may = np.maximum(top, 0) + ROOM >= bound[:, None]
    return {c: np.setdiff1d(np.flatnonzero(may[:, c]), near[c]) for c in range(len(index.centres)) if index.counts[c]}


def recall_by_probes(index: Index, queries: DataFrame, k: int = 10, threshold: float = -2.0) -> DataFrame:
    """(probes, recall, share): for each number of probes, the share of exact neighbours found and of points read.

    The cells that hold each exact neighbour are ranked by nearness to the query, so one
    exact search measures every number of probes.
    """
    spark = queries.sparkSession
    exact = search(index, queries, k, None, threshold).select("query_id", "id")
    where = index.points(spark).select("id", "cell")
    pairs = exact.join(where, "id").join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "query_id").select("cell", "embedding")
    centres, counts = index.centres, index.counts

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, read = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for batch in batches:
            order = _cells_by_nearness(_matrix(batch.column(1), centres.shape[1]), centres)
            hits += np.bincount((order == np.asarray(batch.column(0))[:, None]).argmax(axis=1), minlength=len(centres))
            read += np.cumsum(counts[order], axis=1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(centres) + 1), pa.int32()), pa.array(hits), pa.array(read)], names=["probes", "hits", "read"])

    each = pairs.mapInArrow(ranks, "probes int, hits long, read double").groupBy("probes").agg(F.sum("hits").alias("hits"), F.sum("read").alias("read"))
    from pyspark.sql import Window

    upto = Window.orderBy("probes")  # a row for each number of probes, MOST_CELLS at most
    all_hits = F.sum("hits").over(Window.partitionBy())
    return each.select("probes", F.round(F.sum("hits").over(upto) / all_hits, 6).alias("recall"), F.round(F.col("read") / (all_hits * int(counts.sum())), 6).alias("share"))


def probes_for(index: Index, queries: DataFrame, k: int = 10, recall: float = 0.95, threshold: float = -2.0) -> int:
    """The least number of probes with the wanted recall on at most ``TUNING_QUERIES`` queries."""
    n = queries.count()
    some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(max(1, n // TUNING_QUERIES))) == 0).limit(2 * TUNING_QUERIES)
    enough = recall_by_probes(index, some, k, threshold).filter(F.col("recall") >= recall).agg(F.min("probes").alias("p")).first()["p"]
    return enough or len(index.centres)
