"""The best rows of each query by inner product, exactly, as products of blocks.

Queries are taken in blocks of bounded size, each broadcast to a scan of all rows. A task
scores some rows with a block as a product of matrices, a table of at most ``CELLS`` scores
at a time, and keeps the best k of each query; the k-th score so far is a bound that later
rows must reach. So no pair of a row and a query is shuffled, only k rows of each query
and task, and memory depends on neither the rows nor the number of blocks.

Sparse vectors have their lengths too: a score is at most the product of both lengths, so
a query needs the rows alone that are long enough to reach its bound, the k-th of what
scores with the longest rows are at least. Blocks hold queries that need rows of like
length; only those that need short rows have them read. Of a row that is long enough, a
product of the commonest words in single precision, with both lengths of all others, says
what its scores are at most; those that may do are worked out in full. No row of the k
best is lost: one is left out only if its score is below one that k other rows have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.session import fresh_path, ship, small_batches

#: Embeddings of queries in one block.
BLOCK_ROWS = 10_000
#: Words of queries, summed over the queries, in one block.
BLOCK_PAIRS = 4_000_000
#: Scores that a task holds as a table at once, and products of words that it adds up at once.
CELLS, ADDED = 1 << 21, 1 << 20
#: Found rows at which a task cuts to the best k.
PENDING = 1 << 20
#: Words of a block that are multiplied as a matrix.
COMMON = 1024
#: Parts at least, by the lengths they need, in which queries are written.
RANGES = 16
#: The longest rows, so many times k and this many at most, give the first bounds of a sparse search.
FIRST, MOST_FIRST = 32, 1 << 14
#: Room for sums of doubles in another order.
SLACK = 1 - 1e-9


class Best:
    """The k best rows of each query that were shown so far, or all of at least the bound without k."""

    def __init__(self, bound: np.ndarray, k: int | None):
        self.bound, self.k, self.pending, self.held = bound.copy(), k, 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array, row: np.ndarray) -> None:
        """Scores of queries with rows, which are places in ``ids``; NaN is above all numbers, as Spark has it."""
        keep = ~(score < self.bound[query])
        if keep.any():
            self.parts.append((query[keep], score[keep], ids.take(pa.array(row[keep]))))
            self.pending += int(keep.sum())
            if self.k is not None and self.pending > max(PENDING, self.held):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        if not self.parts:
            return None
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        if self.k is not None:
            plain = pa.types.is_integer(ids.type) and not ids.null_count
            order = np.lexsort((np.asarray(ids) if plain else pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy(), -score, ~np.isnan(score), query))
            nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            last = order[nth == self.k - 1]
            self.bound[query[last]] = np.fmax(self.bound[query[last]], score[last])
            order = order[nth < self.k]
            query, score, ids = query[order], score[order], ids.take(pa.array(order))
        self.parts, self.pending, self.held = [(query, score, ids)], 0, len(query)
        return self.parts[0]

    def batches(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """What is held as (query_id, id, score); afterwards nothing is."""
        found = self.settle()
        self.parts, self.pending, self.held = [], 0, 0
        for low in range(0, len(found[0]) if found else 0, PENDING):
            query, score, ids = (x[low : low + PENDING] for x in found)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids, pa.array(score)], names=["query_id", "id", "score"])


# --- embeddings ------------------------------------------------------------


def whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of embeddings of that width without null components, and those as a matrix."""
    n = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(n == width)
    flat = column.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(at), width)
    if flat.null_count:
        full = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(at), width).all(axis=1)
        at, x = at[full], x[full]
    return at, x


def show(best: Best, x: np.ndarray, row: np.ndarray, ids: pa.Array, q: np.ndarray, mine: np.ndarray | None, digits: int) -> None:
    """Score rows x, which are the places ``row`` in ``ids``, with the queries q, or those of them that are ``mine``."""
    some = q if mine is None else q[mine]
    room = 1e-9 + 10.0**-digits
    with np.errstate(over="ignore", invalid="ignore"):
        light, few = x.astype(np.float32), some.astype(np.float32)
        # a table in single precision may be off by a share of both lengths; what it lets through is summed in full
        room += _fuzz(x.shape[1]) * float(np.sqrt((x * x).sum(axis=1).max(initial=0.0) * (some * some).sum(axis=1).max(initial=0.0)))
    if not (np.isfinite(light).all() and np.isfinite(few).all()):
        light, few = x, some
    step = max(1, CELLS // max(1, len(some)))
    for low in range(0, len(x), step):
        part = x[low : low + step]
        with np.errstate(over="ignore", invalid="ignore"):
            table = light[low : low + step] @ few.T
            bound = (best.bound if mine is None else best.bound[mine]) - room
            able = ~(table < bound.astype(np.float32))
            # the best k of these rows alone, where bounds leave most in
            if best.k is not None and not best.held and len(part) > best.k and 8 * np.count_nonzero(able) > able.size:
                able &= ~(table < np.partition(table, -best.k, axis=0)[-best.k] - np.float32(2 * room))
        i, j = np.nonzero(able)
        # sums go from the first component to the last, as Spark sums them
        score = np.zeros(len(i))
        for c in range(x.shape[1]):
            score += part[:, c][i] * some[:, c][j]
        best.add(j if mine is None else mine[j], np.round(score, digits), ids, row[low + i])


def _blocks(queries: DataFrame, rows: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and embeddings of the queries, about so many rows at a time, those of one width together."""
    q = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-q.count() // rows))
    for b in range(blocks):
        some = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        vectors = some["embedding"].combine_chunks()
        for width in np.unique(pc.list_value_length(vectors).to_numpy(zero_copy_only=False)) if len(some) else ():
            at, x = whole(vectors, int(width))
            if len(at):
                yield some["query_id"].combine_chunks().take(pa.array(at)), x


def dense(points: DataFrame, queries: DataFrame, k: int | None, threshold: float, digits: int = 6, rows: int | None = None) -> DataFrame:
    """(query_id, id, score): points of at least the threshold, the best k of each query in each task, or all."""
    spark = points.sparkSession
    ship(spark)
    kinds = {"id": dict(points.dtypes)["id"], "query_id": dict(queries.dtypes)["query_id"]}
    # embeddings are small; as they are stored, one task may have them all
    dealt = points.select("id", F.col("embedding").cast("array<double>").alias("embedding")).repartition(spark.sparkContext.defaultParallelism)
    parts = [spark.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['id']}, score double")]
    for names, q in _blocks(queries, rows or BLOCK_ROWS):
        shared = spark.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = Best(np.full(len(q), threshold), k)
            for batch in batches:
                at, x = whole(batch.column(1), q.shape[1])
                for low in range(0, len(at), 1024):
                    show(best, x[low : low + 1024], at[low : low + 1024], batch.column(0), q, None, digits)
                    if k is None:
                        yield from best.batches(names)
            yield from best.batches(names)

        parts.append(dealt.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double"))
    return reduce(DataFrame.union, parts)


# --- words -----------------------------------------------------------------


@dataclass
class Vectors:
    """Rows (id, terms, weights, norm) below a path."""

    spark: SparkSession
    path: str
    id_kind: str
    whole: bool

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_kind}, terms array<string>, weights array<double>, norm double").parquet(self.path)

    @staticmethod
    def pairs(rows: DataFrame) -> DataFrame:
        """(query_id, term, weight) of some of the rows, as queries."""
        each = rows.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("terms", "weights")).alias("p"))
        return each.select("query_id", F.col("p.terms").alias("term"), F.col("p.weights").alias("weight"))


def _write(docs: DataFrame, id_kind: str, whole: bool) -> Vectors:
    path = fresh_path(docs.sparkSession, "vectors")
    docs.sortWithinPartitions(F.desc("norm")).write.option("parquet.block.size", 4 << 20).parquet(path)  # small row groups, as short rows are seldom read
    return Vectors(docs.sparkSession, path, id_kind, whole)


def vectors(weights: DataFrame) -> Vectors:
    """Write (id, term, weight), a row for each word of a document, as a row for each document, the longest of a part first."""
    kinds = dict(weights.dtypes)
    rows = weights.filter(F.col("term").isNotNull() & (F.col("weight") != 0)).withColumn("weight", F.col("weight").cast("double"))
    docs = rows.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return _write(docs, kinds["id"], kinds["weight"] in ("bigint", "int"))


def word_table(spark: SparkSession) -> np.ndarray:
    """Of each code point, whether a word may hold it, as ``text.WORD`` says in Spark's own regular expressions; as bits."""
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        # UTF-32 leaves surrogates out; a row for each letter or digit, whatever the corpus
        each = spark.range(0x110000).filter("id < 55296 OR id > 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
        table = np.zeros(0x110000, bool)
        table[each.filter(F.col("c").rlike(text.WORD)).select("id").toArrow()["id"].to_numpy()] = True
        _TABLES[app] = np.packbits(table)
    return _TABLES[app]


_TABLES: dict[str, np.ndarray] = {}


def cut(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of word characters and runs of others, in order: the runs, whose each is, and whether it is a word.

    Texts stay as they are: runs are places in their bytes, and only characters beyond ASCII are decoded.
    """
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low, high = int(ends[0]), int(ends[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]
    ends = ends - low
    word = np.append(table[:128], np.zeros(128, bool))[data]
    first = np.flatnonzero(data >= 0xC0)
    if len(first):
        b = [data[np.minimum(first + i, len(data) - 1)].astype(np.int64) for i in range(4)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        tail = [x & 0x3F for x in b]
        point = np.where(size == 2, (b[0] & 0x1F) << 6 | tail[1], np.where(size == 3, (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2], (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))
        inside = table[np.minimum(point, len(table) - 1)]
        for i in range(4):
            word[first[inside & (size > i)] + i] = True
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = word[1:] != word[:-1]
    begins[ends] = True
    start = np.flatnonzero(begins[:-1])
    runs = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return runs, np.searchsorted(ends[1:], start, side="right"), word[start]


def _counted(ids: pa.Array, texts: pa.Array, table: np.ndarray) -> pa.RecordBatch:
    """Rows with words, each word once with its count, and their lengths."""
    runs, row, mine = cut(texts, table)
    coded = runs.dictionary_encode()
    size = max(1, len(coded.dictionary))
    found, n = np.unique(row[mine] * size + np.asarray(coded.indices)[mine], return_counts=True)
    row, n = found // size, n.astype(np.float64)
    some, first = np.unique(row, return_index=True)
    offsets = pa.array(np.append(first, len(row)), pa.int32())
    terms = coded.dictionary.take(pa.array(found % size))
    norm = np.sqrt(np.add.reduceat(n * n, first)) if len(first) else np.empty(0)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(n)), pa.array(norm)], names=["id", "terms", "weights", "norm"])


def word_vectors(docs: DataFrame, key: str, column: str) -> Vectors:
    """The vectors of ``search.term_weights``: counts of each word of a text, without a row for each word.

    Texts are cut as bytes, a batch at a time. Those of a repeated id count as one; only then are words shuffled.
    """
    from corpusforge.operators.search import term_weights

    spark = docs.sparkSession
    if not docs.groupBy(key).count().filter("count > 1").isEmpty():
        return vectors(term_weights(docs, key, column))
    ship(spark)
    small_batches(spark)
    rows = docs.select(F.col(key).alias("id"), F.lower(F.coalesce(F.col(column), F.lit(""))).alias("text"))
    kind = dict(rows.dtypes)["id"]
    bits = word_table(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits).astype(bool)
        for batch in batches:
            yield _counted(batch.column(0), batch.column(1), table)

    return _write(rows.mapInArrow(run, f"id {kind}, terms array<string>, weights array<double>, norm double"), kind, True)


@dataclass
class _Words:
    """A block of queries, by the length that a row must have to reach their bounds, and their words."""

    names: pa.Array
    terms: pa.Array  # words, those of most queries first
    norm: np.ndarray  # of each query
    bound: np.ndarray  # of each query
    start: np.ndarray  # of each query, where its pairs begin; and their end
    term: np.ndarray  # of each pair
    weight: np.ndarray  # of each pair
    k: int

    @property
    def need(self) -> np.ndarray:
        return self.bound / self.norm * SLACK

    @property
    def common(self) -> int:
        return min(COMMON, len(self.terms))

    @cached_property
    def table(self) -> np.ndarray:
        """Of each query the weights of the common words, the length of its others, and its own."""
        query = np.repeat(np.arange(len(self.names)), np.diff(self.start))
        return _dense(query, self.term, self.weight, self.norm, self.common)

    @cached_property
    def whole(self) -> bool:
        return not (self.weight % 1).any()

    @cached_property
    def exact(self) -> np.ndarray:
        """Of each common word the weights in all queries, in double precision."""
        out, mine = np.zeros((self.common, len(self.names))), self.term < self.common
        out[self.term[mine], np.repeat(np.arange(len(self.names)), np.diff(self.start))[mine]] = self.weight[mine]
        return out

    @cached_property
    def others(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of other words by word: where each word's begin, their queries and weights."""
        some = np.flatnonzero(self.term >= self.common)
        some = some[np.argsort(self.term[some], kind="stable")]
        query = np.repeat(np.arange(len(self.names)), np.diff(self.start))[some]
        return np.searchsorted(self.term[some], np.arange(len(self.terms) + 1)), query, self.weight[some]


def _dense(row: np.ndarray, term: np.ndarray, weight: np.ndarray, norm: np.ndarray, common: int, rest: float = 1.0, fuzz: float = 1.0) -> np.ndarray:
    """Rows with their weights of the first words, the length of their others times ``rest``, and their own times ``fuzz``."""
    out = np.zeros((len(norm), common + 2), np.float32)
    mine = term < common
    out[row[mine], term[mine]] = weight[mine]
    out[:, common] = np.sqrt(np.bincount(row[~mine], weight[~mine] ** 2, minlength=len(norm))) * rest
    out[:, common + 1] = norm * fuzz
    return out


def _fuzz(common: int) -> float:
    """What single precision may add to or take from a product of so many words, and more, as a share of both lengths."""
    return (common + 16) * 2.0**-22


def _words(rows: pa.Table, k: int) -> _Words:
    """A block of (query_id, terms, weights, norm, bound)."""
    rows = rows.take(np.argsort(rows["bound"].to_numpy() / rows["norm"].to_numpy(), kind="stable"))
    lists = rows["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    term = np.asarray(coded.indices).astype(np.int64)
    order = np.argsort(-np.bincount(term, minlength=len(coded.dictionary)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    start = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
    weight = pc.list_flatten(rows["weights"]).to_numpy().astype(np.float64)
    return _Words(rows["query_id"].combine_chunks(), coded.dictionary.take(pa.array(order)), rows["norm"].to_numpy(), rows["bound"].to_numpy(), start, place[term], weight, k)


class _Scorer:
    def __init__(self, block: _Words):
        self.block, self.best = block, Best(block.bound, block.k)
        self.need = block.need
        self.row = np.zeros(len(block.terms))

    def batch(self, ids: pa.Array, terms: pa.Array, weights: np.ndarray, sizes: np.ndarray, norms: np.ndarray) -> None:
        """Rows, their words one row after the other, and their lengths."""
        b = self.block
        found = pc.index_in(terms, value_set=b.terms)
        mine = found.is_valid().to_numpy(zero_copy_only=False)
        of, term, weight = np.repeat(np.arange(len(sizes)), sizes)[mine], np.asarray(found.drop_null()).astype(np.int64), weights[mine]
        start = np.searchsorted(of, np.arange(len(sizes) + 1))
        order = np.argsort(-norms, kind="stable")
        low = 0
        while low < len(order):
            longest = norms[order[low]]
            # queries stand by what they needed at first; bounds that rose since leave more of them out
            active = int(np.searchsorted(self.need, longest, side="right"))
            if not active:
                break
            high = low + int(np.searchsorted(-norms[order[low : low + max(1, CELLS // active)]], -0.8 * longest, side="right"))
            rows = order[low:high]
            size = start[rows + 1] - start[rows]
            place, row = _spread(start[rows], size)
            self._some(ids, rows, row, term[place], weight[place], norms[rows], active)
            low = high

    def _some(self, ids: pa.Array, rows: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, norms: np.ndarray, active: int) -> None:
        """Rows against the first queries: what a score is at most, from the common words and both lengths of the others, and those that may do in full."""
        b = self.block
        live = np.flatnonzero(self.best.bound[:active] * SLACK <= norms[0] * b.norm[:active])
        if not len(live):
            return
        some = slice(active) if 2 * len(live) > active else live
        left, table = _dense(row, term, weight, norms, b.common, 1 + 1e-6, _fuzz(b.common)), b.table[some]
        product = left[:, :-2] @ table[:, :-2].T
        most = product + left[:, -2:] @ table[:, -2:].T
        i, j = np.nonzero(~(most < (self.best.bound[some] * SLACK).astype(np.float32)))
        if not len(i):
            return
        j = j if isinstance(some, slice) else some[j]
        other = term >= b.common
        first = b.others[0]
        hits = np.unique(i)
        # nanoseconds: of a pair looked up and of a row for that, against a product added and a score of common words
        if 7 * (b.start[j + 1] - b.start[j]).sum() + 50_000 * len(hits) > 25 * (first[term[other] + 1] - first[term[other]]).sum() + 150 * most.size:
            # whole numbers below 2^24 are exact in single precision
            whole = norms[0] * table[:, -1].max() < 1 << 23 and b.whole and not (weight % 1).any()
            score = self._all(product.astype(np.float64) if whole else None, len(rows), row, term, weight, some, most.shape[1])
            i, j = np.nonzero(score)
            score, j = score[i, j], j if isinstance(some, slice) else some[j]
        else:
            score = np.empty(len(i))
            begin, of = np.searchsorted(row, np.arange(len(rows) + 1)), np.searchsorted(i, np.arange(len(rows) + 1))
            for r in hits:
                mine = slice(begin[r], begin[r + 1])
                self.row[term[mine]] = weight[mine]
                self._full(j[of[r] : of[r + 1]], score[of[r] : of[r + 1]])
                self.row[term[mine]] = 0.0
        keep = score > 0
        self.best.add(j[keep], score[keep], ids, rows[i[keep]])

    def _all(self, scores: np.ndarray | None, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, some: slice | np.ndarray, width: int) -> np.ndarray:
        """The scores of all of n rows with some queries: common words as a matrix, if not given, products of others added up some at a time."""
        b = self.block
        first, query, weights = b.others
        of = term >= b.common
        if scores is None:
            left = np.zeros((n, b.common))
            left[row[~of], term[~of]] = weight[~of]
            scores = left @ b.exact[:, some]
        row, term, weight = row[of], term[of], weight[of]
        column = np.full(len(b.names), -1)
        column[some] = np.arange(width)
        size = first[term + 1] - first[term]
        upto = np.cumsum(size)
        low = 0
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + ADDED, side="right")))
            place, whose = _spread(first[term[low:high]], size[low:high])
            at = column[query[place]]
            on = at >= 0
            place, whose, at = place[on], whose[on] + low, at[on]
            scores += np.bincount(row[whose] * width + at, weights[place] * weight[whose], minlength=scores.size).reshape(scores.shape)
            low = high
        return scores

    def _full(self, query: np.ndarray, score: np.ndarray) -> None:
        """The scores of the row at hand with queries, some pairs at a time."""
        b = self.block
        size = b.start[query + 1] - b.start[query]
        upto = np.cumsum(size)
        low = 0
        while low < len(query):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + ADDED, side="right")))
            place, _ = _spread(b.start[query[low:high]], size[low:high], False)
            score[low:high] = np.add.reduceat(self.row[b.term[place]] * b.weight[place], upto[low:high] - size[low:high] - (upto[low - 1] if low else 0))
            low = high


def _spread(start: np.ndarray, n: np.ndarray, whose: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The places of stretches (their starts and sizes), and whose each place is."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), np.repeat(np.arange(len(n)), n) if whose else None


def _flat(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (_, terms, weights, norm): all words, their weights, the number of each row, and the rows' lengths."""
    sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column(1).flatten(), np.asarray(batch.column(2).flatten(), np.float64), sizes, np.asarray(batch.column(3), np.float64)


def _scan(rows: DataFrame, block: _Words, query_kind: str) -> DataFrame:
    """(query_id, id, score): the best k of each query in each task."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            scorer.batch(batch.column(0), *_flat(batch))
        yield from scorer.best.batches(scorer.block.names)

    return rows.select("id", "terms", "weights", "norm").mapInArrow(run, f"query_id {query_kind}, id {dict(rows.dtypes)['id']}, score double")


def _asked(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """Queries (query_id, terms, weights, norm) of such rows, or of (query_id, term, weight)."""
    if "terms" in queries.columns:
        return queries.filter("query_id IS NOT NULL").select("query_id", "terms", "weights", "norm")
    pairs = queries.filter(F.col("query_id").isNotNull() & F.col("term").isNotNull()).groupBy("query_id", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    return pairs.filter("weight <> 0").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def _common(rows: DataFrame, vocabulary: pa.Array, sign: float) -> DataFrame:
    """Rows with ``x``, their weights of these words and both lengths, in single precision; with a sign, to be taken off a product."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            terms, weights, sizes, norms = _flat(batch)
            found = pc.index_in(terms, value_set=words).fill_null(len(words)).to_numpy().astype(np.int64)
            x = _dense(np.repeat(np.arange(len(sizes)), sizes), found, weights, norms, len(words), sign * (1 + 1e-6), sign * _fuzz(len(words)))
            flat = pa.array(x.reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)], names=[*batch.schema.names, "x"])

    return rows.mapInArrow(run, f"{kinds}, x array<float>")


def _bounded(rows: DataFrame, asked: DataFrame, k: int, threshold: float) -> DataFrame:
    """Queries with ``bound``, which k rows reach or pass: the k-th of what scores with the longest rows are at least."""
    spark = rows.sparkSession
    first = min(FIRST * k, MOST_FIRST)
    cutoff = rows.select("norm").orderBy(F.desc("norm")).limit(first).agg(F.min("norm")).first()[0]
    path = fresh_path(spark, "longest")
    rows.filter(F.col("norm") >= F.lit(cutoff)).limit(first).repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    longest = spark.read.schema(rows.schema).parquet(path)
    squares = longest.select(F.explode(F.arrays_zip("terms", "weights")).alias("p")).groupBy("p.terms").agg(F.sum(F.col("p.weights") * F.col("p.weights")).alias("n"))
    vocabulary = squares.orderBy(F.desc("n"), "terms").limit(COMMON).select("terms").toArrow()["terms"].combine_chunks()
    table = _common(longest, vocabulary, -1.0).select("x").toArrow()["x"].combine_chunks()  # the longest rows alone, and their common words
    positive = longest.agg(F.min(F.array_min("weights"))).first()[0] > 0
    shared = spark.sparkContext.broadcast((vocabulary, table.flatten().to_numpy().reshape(len(table), -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = shared.value
        step = max(1, CELLS // max(1, len(table)))
        for batch in batches:
            terms, weights, sizes, norms = _flat(batch)
            found = pc.index_in(terms, value_set=vocabulary).fill_null(len(vocabulary)).to_numpy().astype(np.int64)
            x = _dense(np.repeat(np.arange(len(sizes)), sizes), found, weights, norms, len(vocabulary))
            if positive and (weights > 0).all():  # then the other words take nothing off
                x[:, len(vocabulary)] = 0.0
            bound = np.full(len(x), max(threshold, 0.0))
            if len(table) >= k:
                for low in range(0, len(x), step):
                    least = x[low : low + step] @ table.T
                    kth = np.partition(least, len(table) - k, axis=1)[:, len(table) - k].astype(np.float64)
                    bound[low : low + step] = np.fmax(bound[low : low + step], np.where(np.isfinite(kth), kth * SLACK, 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], names=[*batch.schema.names, "bound"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in asked.dtypes)
    return asked.mapInArrow(run, f"{kinds}, bound double")


def sparse(index: Vectors, queries: DataFrame, k: int, threshold: float = 0.0, within: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows of each query (query_id, term, weight); scores are above 0.

    Queries may be rows (query_id, terms, weights, norm) too. ``within`` (id) leaves other rows out before any cut.
    Blocks are of queries that need rows of like length, so that those which need short rows don't have
    them read for the others.
    """
    spark = index.spark
    ship(spark)
    small_batches(spark)
    if within is not None:
        index = _write(index.rows.join(within.select("id"), "id", "left_semi"), index.id_kind, index.whole)
    rows = index.rows
    asked = _asked(spark, queries)
    kind = dict(asked.dtypes)["query_id"]
    parts = [spark.createDataFrame([], f"query_id {kind}, id {index.id_kind}, score double")]
    path, bounded = fresh_path(spark, "queries"), fresh_path(spark, "bounded")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    if pairs and not rows.isEmpty():
        found = _bounded(rows, asked, k, threshold).withColumn("need", F.col("bound") / F.col("norm"))
        found.repartitionByRange(max(RANGES, -(-4 * pairs // BLOCK_PAIRS)), "need").write.parquet(bounded)
        asked = spark.read.schema(found.schema).parquet(bounded)
        for files, part, of in _blocks_of(asked):
            some = spark.read.schema(found.schema).parquet(*files)
            some = some if of == 1 else some.filter(F.pmod(F.xxhash64("query_id"), F.lit(of)) == part)
            table = some.toArrow()  # about BLOCK_PAIRS pairs
            if len(table):
                block = _words(table, k)
                parts.append(_scan(rows.filter(F.col("norm") >= float(block.need.min())), block, kind))
    found = reduce(DataFrame.union, parts)
    found = found.withColumn("score", F.round("score").cast("long")) if index.whole else found
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    return ranked.filter(F.col("score") >= threshold)


def _blocks_of(asked: DataFrame) -> list[tuple[list[str], int, int]]:
    """Files of queries put together to blocks by what they need, and which part by hash of how many."""
    each = asked.groupBy(F.input_file_name().alias("file")).agg(F.min("need").alias("need"), F.sum(F.size("terms")).alias("n")).orderBy("need").collect()  # a row for each file
    out: list[tuple[list[str], int, int]] = []
    room, least = 0, 0.0
    for f in each:
        if f["n"] <= room and f["need"] <= 2 * least:
            out[-1][0].append(f["file"])
            room -= f["n"]
        else:
            of = max(1, -(-f["n"] // BLOCK_PAIRS))
            out += [([f["file"]], part, of) for part in range(of)]
            room, least = BLOCK_PAIRS - f["n"] if of == 1 else 0, f["need"]
    return out
