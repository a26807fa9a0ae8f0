"""The best documents of each item by weighted words: thresholds first, then candidates.

A document's words are counted once into postings: for each document its number of
words and, for each distinct word, a keyed 64-bit hash and how often it stands there.
For the items' words Spark keeps the document frequency and the impacts of the 50
documents where the word counts most. A word's impact in an item's score never depends
on its other words, so:

- any sum of stored impacts of a document is at most its score; the 50th largest such
  sum of an item is a lower bound of its 50th best score, and so is the 50th stored
  impact of any of its words alone;
- with an item's words in ascending order of their greatest impact, a document that
  holds only words whose greatest impacts sum to less than that bound can't be among its
  best. Candidates are the documents with one of the others, if what they have of these
  and the greatest impacts of the rest together reach the bound. Only they are rescored,
  exactly, over all words of the item.

The items are taken in blocks of bounded size, each given to one pass over the postings,
where a document's words stand together, so no posting is shuffled for it. A task raises
its bounds as it finds better documents and gives out at most 50 of each item; Spark's
windows pick the best of all tasks. Bounds are never above the 50th score, and candidates
at just the bound stay, so no document is lost, however words are spread.

Defined results: null texts, and texts without words, have no terms and count for
nothing; items without words give no rows; rows that share an item_id (null too) are one
item with the words of all; rows that repeat a doc_id are documents of their own, and
null ids come last of equal scores; texts are read whole; other columns are left out.
Words are told apart by keyed 64-bit hashes, as in ``corpusforge/llm/common.py``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm import common

K, K1, B = 50, 1000, 50
#: Words of items, summed over the items, in one block; about 40 bytes each in the tasks and the driver.
BLOCK_PAIRS = 200_000
#: Cells of a table of scores, documents by items, that a task holds at once.
CELLS = 1 << 21
#: Postings of documents that a task works on at once.
AT_ONCE = 1 << 18


# --- postings ----------------------------------------------------------------


class Words:
    """Counts of a text's words by hash; hashes of words met before are remembered."""

    KEPT = 1 << 20

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def count(self, text: bytes) -> Counter:
        found, at = Counter(), 0
        low = text.translate(common.ALNUM_WORDS)
        while at < len(low):  # a long text in steps, so that its words are never all held
            end = low.find(b" ", at + common.SLICE_BYTES)
            end = len(low) if end < 0 else end
            found.update(low[at:end].split())
            at = end
        return found

    def hashes(self, counts: list[Counter]) -> list[np.ndarray]:
        if len(self.memo) > self.KEPT:
            self.memo = {}
        new = list(set().union(*counts).difference(self.memo))
        self.memo.update(zip(new, common.hash_words(new).view(np.int64).tolist(), strict=True))
        return [np.fromiter(map(self.memo.__getitem__, c), np.int64, len(c)) for c in counts]


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, terms, tf): each row's words, their number and that of each distinct one."""
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                counts = [words.count(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                terms = words.hashes(counts)
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in terms])]), pa.int32())
                tf = np.fromiter((n for c in counts for n in c.values()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([sum(c.values()) for c in counts], pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(terms))), pa.ListArray.from_arrays(cuts, pa.array(tf))],
                    names=["id", "n", "terms", "tf"],
                )

    return common.map_arrow(rows, run, f"id {kind}, n long, terms array<long>, tf array<long>")


def _length(n, documents: int, total: int):
    """The contract's m of a document with n words."""
    return 100 - B + (B * n * documents) // max(total, 1)


def _impact(tf, m):
    return (1_000_000_000 * tf) // (K1 * tf + 20 * m)


# --- a block of items in a task ----------------------------------------------


@dataclass
class Block:
    """Items of a block by number, their words ascending by greatest impact, and bounds."""

    terms: np.ndarray  # hashes, ascending
    weight: np.ndarray  # of each term
    item: np.ndarray  # of each pair; pairs of an item stand together
    names: pa.Array  # the items themselves, by number
    term: np.ndarray  # of each pair, a place in ``terms``
    upto: np.ndarray  # greatest impacts of an item's words up to this pair, summed
    bound: np.ndarray  # of each item
    documents: int
    total: int
    k: int

    @property
    def items(self) -> int:
        return len(self.bound)


class Scorer:
    """The best documents of a block's items among those that it is shown."""

    def __init__(self, block: Block):
        self.block, self.bound = block, block.bound.copy()
        self.first = np.searchsorted(block.item, np.arange(block.items + 1))
        self.by_term = np.argsort(block.term, kind="stable")
        self.found = tuple(np.empty(0, np.int64) for _ in range(4))  # item, score, id, whether it has an id

    def _split(self) -> None:
        """Which pairs make candidates, and what the others can add at most."""
        b = self.block
        self.leads = b.upto >= self.bound[b.item]
        others = np.bincount(b.item[~self.leads], minlength=b.items)
        self.others = others
        last = self.first[:-1] + others - 1
        self.rest = np.where(others > 0, b.upto[np.maximum(last, 0)], 0)
        kept = self.by_term[self.leads[self.by_term]]
        self.lead_items = b.item[kept]
        self.lead_first = np.searchsorted(b.term[kept], np.arange(len(b.terms) + 1))

    def show(self, ids: np.ndarray, known: np.ndarray, n: np.ndarray, cuts: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """Documents and their postings; ``cuts`` says where each one's begin."""
        b = self.block
        if not len(b.terms) or not len(terms):
            return
        self._split()
        at = np.searchsorted(b.terms, terms)
        at[at == len(b.terms)] = 0
        mine = b.terms[at] == terms
        doc = np.repeat(np.arange(len(ids)), np.diff(cuts))[mine]
        t = at[mine]
        gain = b.weight[t] * _impact(tf[mine], _length(n, b.documents, b.total)[doc])
        step = max(1, CELLS // b.items)
        for low in range(0, len(ids), step):
            x, y = np.searchsorted(doc, [low, low + step])
            if x < y:
                self._some(ids[low : low + step], known[low : low + step], doc[x:y] - low, t[x:y], gain[x:y])

    def _some(self, ids, known, doc, t, gain) -> None:
        b = self.block
        copies = self.lead_first[t + 1] - self.lead_first[t]
        ends = np.cumsum(copies)
        if not ends[-1]:
            return
        item = self.lead_items[np.repeat(self.lead_first[t] - ends + copies, copies) + np.arange(ends[-1])]
        cell = np.repeat(doc, copies) * b.items + item
        if b.upto.max() < 2**53:  # such sums are exact in doubles
            room = np.bincount(cell, np.repeat(gain, copies), minlength=len(ids) * b.items)
        else:
            np.add.at(room := np.zeros(len(ids) * b.items, np.int64), cell, np.repeat(gain, copies))
        room = room.reshape(len(ids), b.items)
        d, i = np.nonzero((room > 0) & (room + self.rest >= self.bound))
        score = room[d, i].astype(np.int64)
        # what the other words of these pairs add
        copies = self.others[i]
        ends = np.cumsum(copies)
        if len(ends) and ends[-1]:
            pair = np.repeat(np.arange(len(d)), copies)
            word = b.term[np.repeat(self.first[i] - ends + copies, copies) + np.arange(ends[-1])]
            key, wanted = doc * len(b.terms) + t, d[pair] * len(b.terms) + word
            order = np.argsort(key, kind="stable")
            place = np.searchsorted(key, wanted, sorter=order)
            place[place == len(key)] = 0
            hit = key[order[place]] == wanted
            np.add.at(score, pair[hit], gain[order[place[hit]]])
        left = (score > 0) & (score >= self.bound[i])
        self._keep(i[left], score[left], ids[d[left]], known[d[left]])

    def _keep(self, item, score, ids, known) -> None:
        item, score, ids, known = (np.concatenate(p) for p in zip(self.found, (item, score, ids, known.astype(np.int64)), strict=True))
        order = np.lexsort((ids, 1 - known, -score, item))
        item, score = item[order], score[order]
        start = np.searchsorted(item, np.arange(self.block.items))
        nth = np.arange(len(item)) - start[item]
        best = nth < self.block.k
        last = nth == self.block.k - 1
        self.bound[item[last]] = np.maximum(self.bound[item[last]], score[last])
        self.found = item[best], score[best], ids[order][best], known[order][best]


def _scored(posted: DataFrame, block: Block, kind: str) -> DataFrame:
    """(item, id, score) of each task's best documents."""
    shared = posted.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            ends = np.asarray(batch.column(2).offsets).astype(np.int64)
            ends = ends[1:] - ends[0]
            a = 0
            while a < len(ends):
                before = int(ends[a - 1]) if a else 0
                z = max(a + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
                some = batch.slice(a, z - a)
                ids = some.column(0)
                scorer.show(
                    np.asarray(ids.fill_null(0)),
                    np.asarray(ids.is_valid()),
                    np.asarray(some.column(1)),
                    np.concatenate([[0], ends[a:z] - before]),
                    np.asarray(some.column(2).flatten()),
                    np.asarray(some.column(3).flatten()),
                )
                a = z
        item, score, ids, known = scorer.found
        yield pa.RecordBatch.from_arrays([shared.value.names.take(pa.array(item)), pa.array(ids, pa.int64(), mask=known == 0), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return common.map_arrow(posted.select("id", "n", "terms", "tf"), run, f"item {kind}, id long, score long")


# --- the plan ------------------------------------------------------------------


def _block(rows: pa.Table, size, k: int) -> Block:
    """(item, term, w, most, bound) of some items as arrays."""
    names = rows["item"].combine_chunks().unique()
    number = np.asarray(pc.index_in(rows["item"].combine_chunks(), names))
    column = lambda c: rows[c].to_numpy().astype(np.int64)
    order = np.lexsort((column("term"), column("most"), number))
    number, most = number[order].astype(np.int64), column("most")[order]
    terms, first, term = np.unique(column("term")[order], return_index=True, return_inverse=True)
    upto = np.cumsum(most)
    start = np.searchsorted(number, np.arange(len(names)))
    upto -= np.repeat(upto[start] - most[start], np.diff(np.append(start, len(number))))
    return Block(terms, column("w")[order][first], number, names, term.astype(np.int64), upto, column("bound")[order][start], size["n"], size["total"], k)


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(item, rank, key, score): the k best documents of each item. ``key`` is a column of whole numbers."""
    spark = docs.sparkSession
    folder = common.fresh_path(spark, "ranked")
    save = lambda frame, name: common.materialise(frame, name, folder)
    posted = postings(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)), key, text)
    posted = save(posted.filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "postings")
    size = posted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    pairs = save(postings(items, item, text).select(F.col("id").alias("item"), F.explode("terms").alias("term")).distinct(), "pairs")

    # what is stored of each word: its frequency, and its greatest impacts
    held = posted.select("row", "n", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("row", "n", F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"))
    held = held.join(pairs.select("term").distinct(), "term", "left_semi")
    counts = save(held.groupBy("term").agg(F.count("*").alias("df")), "counts")
    length = f"({100 - B} + ({B} * n * {size['n']}L) DIV {max(size['total'], 1)}L)"
    part = F.expr(f"(1000000000L * tf) DIV ({K1} * tf + 20 * {length})")
    weight = F.expr(f"CAST(floor(1000 * ln((2 * {size['n']}D + 2) / (2 * df + 1))) AS bigint)")
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part"), "row"))
    top = held.select("term", "row", part.alias("part")).withColumn("nth", nth).filter(F.col("nth") <= k)
    stored = save(top.join(counts, "term").withColumn("w", weight).select("term", "row", "nth", "w", (F.col("w") * F.col("part")).alias("impact")), "stored")

    # bounds of items, by what is stored of their documents
    sums = pairs.join(stored, "term").groupBy("item", "row").agg(F.sum("impact").alias("s"))
    kth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"), "row"))
    bounds = sums.withColumn("nth", kth).filter(F.col("nth") == k).select(F.col("item").alias("of"), F.col("s").alias("bound"))
    words = pairs.join(stored.filter("nth = 1").select("term", "w", F.col("impact").alias("most")), "term")
    faced = words.join(bounds, F.col("item").eqNullSafe(F.col("of")), "left").select("item", "term", "w", "most", F.coalesce("bound", F.lit(0)).alias("bound"))
    faced = save(faced, "faced")

    kind = dict(pairs.dtypes)["item"]
    blocks = -(-faced.count() // BLOCK_PAIRS)
    found = spark.createDataFrame([], f"item {kind}, id long, score long")
    for b in range(blocks):
        some = faced.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()  # about BLOCK_PAIRS rows
        if len(some):
            found = found.union(_scored(posted, _block(some, size, k), kind))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    done = common.materialise(best.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score"), "ranked_rows")
    common.remove(spark, folder)
    return done


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
