"""Exact sparse search by score bounds, over documents in blocks with their greatest weights.

Documents are put in classes by the sum of their weights, a doubling for each class; of
every class the greatest weight of each word is kept. What a document can score is at
most what its class's greatest weights give, so a long document with every word in plenty
doesn't loosen the bounds of the rest.

A search has two phases. The first adds up the greatest stored postings of each query's
strongest words: the k-th largest sum is at most the k-th score, and so a bound. It then
scores the highest classes, as many as hold a few times k documents, whose k-th scores
raise the bounds. The second reads only the other classes that can reach some query's
bound. In each, words that together can't lift a document to the bound make no candidates
(those with the least to give), and of the others, postings whose weight is too low even
with the most of everything else are passed over. Candidates whose lead words and the
most of the rest reach the bound are scored in full. Queries come in blocks of bounded size; a document's
words stand together, so no pair is shuffled, and a task raises its bounds as it goes and
gives out at most k of each query.

So a word that every document holds no longer pairs every document with every query; no
document of the k best is lost, as every step keeps what can reach the bound, ties
included. Weights are whole numbers or doubles; null or negative ones, and ones of 0,
count for nothing, in documents and queries. Equal scores go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.operators.search import top_k
from corpusforge.session import fresh_path, ship

#: Postings that are stored of each word, greatest first, for the bounds of the first phase.
DEPTH = 150
#: Words of a query, those with the most to give, that its first bound comes from.
STRONGEST = 8
#: Times k documents that the classes of the first phase hold.
FIRST = 4
#: Words of queries, summed over the queries, in one block.
BLOCK_PAIRS = 200_000
#: Postings of documents that a task works on at once, and cells of a table of scores.
AT_ONCE, CELLS = 1 << 18, 1 << 21
#: Room for sums of doubles in another order.
SLACK, ROOM = 1 - 1e-9, 1e-9


@dataclass
class Postings:
    """Tables below a path."""

    spark: SparkSession
    path: str
    id_kind: str
    weight_kind: str

    def documents(self, classes: list[int] | None = None) -> DataFrame:
        """(id, terms, weights, class), a row for each document; only the named classes are read."""
        rows = self.spark.read.schema(f"id {self.id_kind}, terms array<string>, weights array<{self.weight_kind}>, class int").parquet(f"{self.path}/documents")
        return rows if classes is None else rows.filter(F.col("class").isin(classes))

    @property
    def words(self) -> DataFrame:
        """(term, class, most)"""
        return self.spark.read.parquet(f"{self.path}/words")

    @property
    def sizes(self) -> DataFrame:
        """(class, n): the documents of each class."""
        return self.spark.read.parquet(f"{self.path}/sizes")

    @property
    def stored(self) -> DataFrame:
        """(term, id, weight): the greatest postings of each word."""
        return self.spark.read.parquet(f"{self.path}/stored")


def build(weights: DataFrame, path: str | None = None, depth: int = DEPTH) -> Postings:
    """Write the tables of (id, term, weight), a row for each word of a document."""
    spark = weights.sparkSession
    path = path or fresh_path(spark, "postings")
    rows = weights.filter((F.col("weight") > 0) & F.col("term").isNotNull())
    docs = rows.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.sum("weight").alias("size"))
    size = F.floor(F.log2(F.greatest(F.col("size").cast("double"), F.lit(1.0)))).cast("int")
    docs.withColumn("class", size).drop("size").repartition("class", F.pmod(F.xxhash64("id"), F.lit(spark.sparkContext.defaultParallelism))).write.partitionBy("class").parquet(f"{path}/documents")
    kinds = dict(rows.dtypes)
    index = Postings(spark, path, kinds["id"], kinds["weight"])
    index.documents().groupBy("class").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/sizes")
    each = index.documents().select("id", "class", F.explode(F.arrays_zip("terms", "weights")).alias("p")).select("id", "class", F.col("p.terms").alias("term"), F.col("p.weights").alias("weight"))
    each.groupBy("term", "class").agg(F.max("weight").alias("most")).write.parquet(f"{path}/words")
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("weight"), "id"))
    each.select("term", "id", "weight").withColumn("nth", nth).filter(F.col("nth") <= depth).drop("nth").write.parquet(f"{path}/stored")
    return index


def load(spark: SparkSession, path: str) -> Postings:
    """The index that was built at a path."""
    kinds = dict(spark.read.parquet(f"{path}/stored").dtypes)
    return Postings(spark, path, kinds["id"], kinds["weight"])


def bounds(index: Postings, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """(query_id, bound) of the queries (query_id, term, weight) whose k-th score has a bound."""
    most = index.words.groupBy("term").agg(F.max("most").alias("most"))
    strong = queries.join(most, "term").withColumn("gain", F.col("weight") * F.col("most"))
    strong = top_k(strong, STRONGEST, [F.desc("gain"), F.asc("term")]).select("query_id", "term", F.col("weight").alias("qw"))
    stored = index.stored if within is None else index.stored.join(within.select("id"), "id", "left_semi")
    sums = strong.join(stored, "term").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("s"))
    return top_k(sums, k, [F.desc("s"), F.asc("id")], rank="n").filter(F.col("n") == k).select("query_id", F.col("s").cast("double").alias("bound"))


@dataclass
class _Block:
    """Queries by number, their words (pairs that stand together for each query), and what classes can give."""

    queries: pa.Array
    terms: pa.Array
    query: np.ndarray  # of each pair
    term: np.ndarray  # of each pair, a place in ``terms``
    weight: np.ndarray  # of each pair
    bound: np.ndarray  # of each query
    most: dict[int, np.ndarray]  # of each class, by term
    k: int

    def total(self, c: int) -> np.ndarray:
        return np.bincount(self.query, self.weight * self.most[c][self.term], minlength=len(self.bound))

    def classes(self) -> list[int]:
        """Those in which some query can reach its bound."""
        return [c for c in self.most if ((t := self.total(c)) > 0).any() and (t >= self.bound * SLACK)[t > 0].any()]


class _Class:
    """What the words of a block's queries are good for in one class, under the bounds given."""

    def __init__(self, b: _Block, c: int, bound: np.ndarray):
        self.bound = bound.copy()
        gain = b.weight * b.most[c][b.term]
        order = np.lexsort((gain, b.query))
        order = order[gain[order] > 0]
        query, gain = b.query[order], gain[order]
        start = np.searchsorted(query, np.arange(len(bound) + 1))
        upto = np.cumsum(gain)
        upto -= np.concatenate([[0.0], upto])[start[query]]
        least = bound * SLACK
        total = np.bincount(query, gain, minlength=len(bound))
        lead = (upto >= least[query] * SLACK) & (total >= least)[query]
        self.rest = np.bincount(query[~lead], gain[~lead], minlength=len(bound))
        # pairs that lead, by term and then by the least weight that matters
        led = order[lead]
        need = np.maximum(0, (least[query] - (total[query] - gain))[lead] / b.weight[led] * SLACK)
        by = np.lexsort((need, b.term[led]))
        self.lead_query, self.lead_weight = b.query[led][by], b.weight[led][by]
        self.lead_key = b.term[led][by] + need[by] / (need[by] + 1)
        self.lead_first = np.searchsorted(b.term[led][by], np.arange(len(b.terms) + 1))
        other = order[~lead & (total >= least)[query]]
        self.other_term, self.other_weight = b.term[other], b.weight[other]
        self.other_first = np.searchsorted(b.query[other], np.arange(len(bound) + 1))
        self.by_term = other[np.argsort(b.term[other], kind="stable")]
        self.by_term_first = np.searchsorted(b.term[self.by_term], np.arange(len(b.terms) + 1))


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of stretches (their starts and sizes), and whose each place is."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), np.repeat(np.arange(len(n)), n)


class _Scorer:
    def __init__(self, block: _Block):
        self.block, self.bound, self.known = block, block.bound.copy(), {}
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None

    def show(self, c: int, ids: pa.Array, sizes: np.ndarray, terms: pa.Array, weights: np.ndarray) -> None:
        """Documents of one class, and their words one document after the other."""
        b = self.block
        if c not in b.most:
            return
        roles = self.known.get(c)
        if roles is None or (self.bound > roles.bound).any():
            roles = self.known[c] = _Class(b, c, self.bound)
        found = pc.index_in(terms, value_set=b.terms)
        mine = np.asarray(found.is_valid())
        doc = np.repeat(np.arange(len(ids)), sizes)[mine]
        t = np.asarray(found.drop_null()).astype(np.int64)
        w = weights[mine]
        step = max(1, CELLS // len(b.bound))
        for low in range(0, len(ids), step):
            x, y = np.searchsorted(doc, [low, low + step])
            if x < y:
                self._some(roles, ids.slice(low, step), doc[x:y] - low, t[x:y], w[x:y])

    def _some(self, roles: _Class, ids: pa.Array, doc: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
        b, n = self.block, len(self.bound)
        # the pairs of a word stand by need: those that this weight meets come first
        start = roles.lead_first[t]
        upto = np.searchsorted(roles.lead_key, t + w / (w + 1) + ROOM, side="right")
        place, of = _spread(start, np.minimum(upto, roles.lead_first[t + 1]) - start)
        partly = np.bincount(doc[of] * n + roles.lead_query[place], roles.lead_weight[place] * w[of], minlength=len(ids) * n).reshape(len(ids), n)
        d, q = np.nonzero((partly > 0) & (partly + roles.rest >= self.bound * SLACK))
        score = partly[d, q]
        # the other words: looked up for each candidate, or added up for all, whichever is less
        looked, added = (roles.other_first[q + 1] - roles.other_first[q]), (roles.by_term_first[t + 1] - roles.by_term_first[t])
        if 8 * looked.sum() > added.sum():
            place, of = _spread(roles.by_term_first[t], added)
            place = roles.by_term[place]
            more = np.bincount(doc[of] * n + b.query[place], b.weight[place] * w[of], minlength=len(ids) * n)
            score = score + more.reshape(len(ids), n)[d, q]
        elif looked.any():
            place, pair = _spread(roles.other_first[q], looked)
            key, wanted = doc * len(b.terms) + t, d[pair] * len(b.terms) + roles.other_term[place]
            order = np.argsort(key, kind="stable")
            at = np.minimum(np.searchsorted(key, wanted, sorter=order), len(key) - 1)
            hit = key[order[at]] == wanted
            score = score + np.bincount(pair[hit], roles.other_weight[place[hit]] * w[order[at[hit]]], minlength=len(d))
        left = score >= self.bound[q] * SLACK
        if left.any():
            self._keep(q[left], score[left], ids.take(pa.array(d[left])))

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        order = np.lexsort((pc.rank(self.ids, tiebreaker="dense").to_numpy(), -score, query))
        nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        last = order[nth == self.block.k - 1]
        self.bound[query[last]] = np.maximum(self.bound[query[last]], score[last])
        order = order[nth < self.block.k]
        self.query, self.score, self.ids = query[order], score[order], self.ids.take(pa.array(order))


def _best(documents: DataFrame, block: _Block, query_kind: str) -> DataFrame:
    """(query_id, id, score): the best k of each query in each task."""
    kind = dict(documents.dtypes)["id"]
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(1))).astype(np.int64))
            classes = np.asarray(batch.column(3))
            a = 0
            while a < len(ends):
                before = int(ends[a - 1]) if a else 0
                z = max(a + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
                z = min(z, a + int(np.argmax(np.append(classes[a:z] != classes[a], True))))  # one class at a time
                some = batch.slice(a, z - a)
                scorer.show(int(classes[a]), some.column(0), np.diff(np.append(before, ends[a:z])), some.column(1).flatten(), np.asarray(some.column(2).flatten(), np.float64))
                a = z
        if scorer.ids is not None:
            yield pa.RecordBatch.from_arrays([scorer.block.queries.take(pa.array(scorer.query)), scorer.ids, pa.array(scorer.score)], names=["query_id", "id", "score"])

    return documents.select("id", "terms", "weights", "class").mapInArrow(run, f"query_id {query_kind}, id {kind}, score double")


def _block(pairs: pa.Table, words: pa.Table, k: int) -> _Block:
    queries, terms = pairs["query_id"].combine_chunks().unique(), pairs["term"].combine_chunks().unique()
    query = np.asarray(pc.index_in(pairs["query_id"].combine_chunks(), queries)).astype(np.int64)
    term = np.asarray(pc.index_in(pairs["term"].combine_chunks(), terms)).astype(np.int64)
    bound = np.zeros(len(queries))
    bound[query] = pairs["bound"].to_numpy()
    at, c, most = np.asarray(pc.index_in(words["term"].combine_chunks(), terms)), words["class"].to_numpy(), words["most"].to_numpy().astype(np.float64)
    by_class = {}
    for i in np.unique(c).tolist():
        by_class[i] = np.zeros(len(terms))
        by_class[i][at[c == i]] = most[c == i]
    order = np.argsort(query, kind="stable")
    return _Block(queries, terms, query[order], term[order], pairs["weight"].to_numpy().astype(np.float64)[order], bound, by_class, k)


def _two_phases(index: Postings, block: _Block, kind: str, within: DataFrame | None) -> DataFrame:
    """(query_id, id, score): the best documents of each query of a block, and some more."""
    allowed = lambda classes: index.documents(classes) if within is None else index.documents(classes).join(within.select("id"), "id", "left_semi")
    sizes = {r["class"]: r["n"] for r in index.sizes.collect()}  # one for each doubling
    first, held = [], 0
    for c in sorted(sizes, reverse=True):
        if held >= FIRST * block.k:
            break
        first.append(c)
        held += sizes[c]
    path = fresh_path(index.spark, "first")
    top_k(_best(allowed(first), block, kind), block.k, [F.desc("score"), F.asc("id")]).drop("rank").write.parquet(path)
    found = index.spark.read.parquet(path)
    kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == block.k).toArrow()  # a row for each query of the block
    if len(kth):
        at = np.asarray(pc.index_in(kth["query_id"].combine_chunks(), block.queries))
        block.bound[at] = np.maximum(block.bound[at], kth["least"].to_numpy())
    rest = [c for c in block.classes() if c not in first]
    return found.union(_best(allowed(rest), block, kind)) if rest else found


def search(index: Postings, queries: DataFrame, k: int = 150, threshold: float = 0.0, within: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents of each query (query_id, term, weight); scores are above 0.

    ``within`` (id) leaves other documents out before any cut.
    """
    spark = index.spark
    queries = queries.filter((F.col("weight") > 0) & F.col("query_id").isNotNull()).select("query_id", "term", "weight")
    path = fresh_path(spark, "queries")
    queries.write.parquet(f"{path}/terms")
    queries = spark.read.parquet(f"{path}/terms")
    queries.join(bounds(index, queries, k, within), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))).write.parquet(f"{path}/faced")
    faced = spark.read.parquet(f"{path}/faced")
    kind = dict(queries.dtypes)["query_id"]
    blocks = -(-faced.count() // BLOCK_PAIRS)
    found = spark.createDataFrame([], f"query_id {kind}, id {index.id_kind}, score double")
    for b in range(blocks):
        some = faced if blocks == 1 else faced.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        pairs = some.toArrow()  # about BLOCK_PAIRS rows
        words = index.words.join(some.select("term").distinct(), "term", "left_semi").toArrow()  # a row for each word and class
        if len(pairs):
            block = _block(pairs, words, k)
            found = found.union(_two_phases(index, block, kind, within))
    whole = all(d in ("bigint", "int") for d in (dict(queries.dtypes)["weight"], index.weight_kind))
    scored = found.withColumn("score", F.round("score").cast("long")) if whole else found
    return top_k(scored.filter(F.col("score") >= threshold), k, [F.desc("score"), F.asc("id")])
