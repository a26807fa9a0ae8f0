"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words letter by letter and writes classes: insults with
weights, which are learned from labelled documents as prefixes and whole words, and
threats, targets, negations and reported speech by fixed words. Small machines over
those classes are composed, and the composition reads one clause at a time. An insult
counts as direct, negated or reported by the state in which it stands, and more with a
target in its clause. A threat is a threatening word and a target within a few words,
either first, and counts unless it is negated or reported. A logistic model of a
document's clauses gives the score.

Only labelled documents outside the held-out quarter are learned from, at most
``MOST_TOXIC`` and ``MOST_CLEAN`` of them, picked by hash; the model has at most
``MOST_PREFIXES`` prefixes. Language, source and id are no inputs of a score.

Defined results: null and empty texts have the score of a text without matches;
without any usable label every score is 0; equal texts have equal scores; a
document with several labels is toxic if one says so; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm import common

MOST_TOXIC, MOST_CLEAN, MOST_PREFIXES = 3000, 6000, 5000
#: A prefix is kept if at least so many toxic documents have it, and by this G-square.
LEAST_DOCS, LEAST_G2 = 3, 20.0
THRESHOLD = 0.3
#: Words after a negation that it covers.
NEGATION_REACH = 3
#: Words within which a threat and its target stand.
THREAT_REACH = 4

# Words of each class.
THREATS = "kill killing murder hurt destroy beat shoot stab burn hang die töten umbringen vernichten erschießen tuer détruire frapper brûler matar golpear destruir quemar".split()
TARGETS = "you your yours yourself he him his she her they them their people du dich dein dir euch ihr tu toi vous ton votre elles eux tú ti usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never nobody neither nor isn wasn aren don doesn didn won cannot nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say wrote writes called calls quoted quotes claimed reported asked replied sagte sagt schrieb nannte behauptete dit disait écrit appelle dijo dice escribió llamó".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;\n]+")
PREFIX_SIZES = range(3, 10)


# --- transducers -----------------------------------------------------------


class Lexicon:
    """A transducer from letters to a class and weight: a trie with outputs at its states.

    A key that ends with ``$`` is written for that word alone, any other for all words
    that begin with it; the deepest output that a word reaches counts.
    """

    def __init__(self, outputs: dict[str, tuple[int, float]]):
        self.next: list[dict[str, int]] = [{}]
        self.out: list[tuple[int, float] | None] = [None]
        for key, value in outputs.items():
            at = 0
            for c in key:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.out.append(None)
                at = self.next[at][c]
            self.out[at] = value

    def read(self, word: str) -> tuple[int, float]:
        at, found = 0, None
        for c in word:
            at = self.next[at].get(c, -1)
            if at < 0:
                break
            found = self.out[at] or found
        else:
            end = self.next[at].get("$")
            found = (end is not None and self.out[end]) or found
        return found or (OTHER, 0.0)


class Machine:
    """A deterministic machine over word classes; ``move(state, class)`` is tabulated."""

    def __init__(self, start, states, move):
        self.start = start
        self.table = {(s, c): move(s, c) for s in states for c in range(6)}
        self.states = list(states)

    def __matmul__(self, other: Machine) -> Machine:
        """Both machines reading the same classes."""
        pairs = [(a, b) for a in self.states for b in other.states]
        return Machine((self.start, other.start), pairs, lambda s, c: (self.table[s[0], c], other.table[s[1], c]))


def negation() -> Machine:
    """The number of words that the last negation still covers."""
    return Machine(0, range(NEGATION_REACH + 1), lambda s, c: NEGATION_REACH if c == NEGATION else max(0, s - (c != TARGET)))


def reported() -> Machine:
    """Whether the clause has come past a verb of speech."""
    return Machine(False, (False, True), lambda s, c: s or c == REPORT)


def targeted() -> Machine:
    return Machine(False, (False, True), lambda s, c: s or c == TARGET)


def threatening() -> Machine:
    """(what was seen, words it still waits): a threat and a target, either first, make it done."""
    idle, done = (OTHER, 0), (INSULT, 0)
    states = [idle, done, *((kind, k) for kind in (THREAT, TARGET) for k in range(1, THREAT_REACH + 1))]

    def move(state, c):
        kind, left = state
        if c in (THREAT, TARGET):
            return done if {kind, c} == {THREAT, TARGET} else (c, THREAT_REACH)
        return (kind, left - 1) if left > 1 else idle

    return Machine(idle, states, move)


THREATENED = (INSULT, 0)
GRAMMAR = negation() @ reported() @ targeted() @ threatening()


@dataclass
class Model:
    """Prefix weights and the logistic layer over a document's features."""

    prefixes: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    center: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def __post_init__(self):
        fixed = {w + "$": (k, 0.0) for k, words in ((TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS)) for w in words}
        self.fixed = Lexicon(fixed)
        self.insults = Lexicon({p: (INSULT, x) for p, x in self.prefixes.items()})
        self.known: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        """The class and weight of a word; what was learned goes before the fixed words."""
        found = self.known.get(word)
        if found is None:
            found = self.insults.read(word)
            if found[1] <= 0:
                found = self.fixed.read(word)
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        read = {w: found for w in set(words) if (found := self.read(w))[0] != OTHER}
        hits = sum(kind == INSULT for kind, _ in read.values())
        out = Counter()
        if hits or any(kind == THREAT for kind, _ in read.values()):
            for clause in _CLAUSE.split(low):
                self._clause(_WORD.findall(clause), read, out)
        total = out["direct"] + out["negated"] + out["reported"]
        per = 100 / (len(words) + 20)
        return [
            np.log1p(total),
            np.log1p(per * total),
            np.log1p(hits),
            np.log1p(out["count"]),
            np.log1p(per * out["count"]),
            out["negated"] / (total + 1),
            out["reported"] / (total + 1),
            out["targeted"] / (total + 1),
            np.log1p(out["threats"]),
        ]

    def _clause(self, words: list[str], read: dict[str, tuple[int, float]], out: Counter) -> None:
        state, own = GRAMMAR.start, Counter()
        for w in words:
            kind, weight = read.get(w, (OTHER, 0.0))
            state = GRAMMAR.table[state, kind]
            ((covered, told), _), threat = state
            if kind == INSULT:
                own["negated" if covered else "reported" if told else "direct"] += weight
                own["count"] += 1
            if threat == THREATENED and not covered and not told:
                own["threats"] += 1
        if state[0][1]:  # a target in the clause
            own["targeted"] = own["direct"]
        out.update(own)

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        x = (np.asarray(self.features(text)) - self.center) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.asarray(self.weights[1:]), -30, 30))))


# --- learning --------------------------------------------------------------


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, weight, text) of a bounded number of rows; weights restore the shares."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    each = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in each.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    parts = []
    for toxic, most in ((True, MOST_TOXIC), (False, MOST_CLEAN)):
        some = each.filter((F.col("toxic") > 0) == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        weight = max(1.0, counts.get(toxic, 0) / most)
        parts.append(some.select("doc_id", F.lit(toxic).alias("toxic"), F.lit(weight).alias("weight")))
    chosen = F.broadcast(common.materialise(parts[0].union(parts[1]), "labelled"))  # at most MOST_TOXIC + MOST_CLEAN rows
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).join(chosen, "doc_id").select("toxic", "weight", "text")
    return common.materialise(rows, "sample")


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to counts by prefix, added up for each slice: documents and occurrences."""
    for batch in batches:
        for a, b in common.slices(batch.column(1)):
            docs, uses = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
            for toxic, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                own = Counter()
                for word, n in Counter(_WORD.findall(text.lower())).items():
                    if len(word) >= 3:
                        for size in PREFIX_SIZES:
                            if size <= len(word):
                                own[word[:size]] += n
                        own[word + "$"] += n
                docs[toxic].update(own.keys())
                uses[toxic].update({p: min(n, 5) for p, n in own.items()})
            names = list(docs[True].keys() | docs[False].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[t][p] for p in names], pa.int64()) for c in (docs, uses) for t in (True, False))],
                names=["prefix", "toxic_docs", "clean_docs", "toxic_uses", "clean_uses"],
            )


def learn_prefixes(sample: DataFrame) -> dict[str, float]:
    """Weights (log odds of a use) of the prefixes that tell toxic documents apart."""
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return {}
    counted = common.map_arrow(sample.select("toxic", "text"), _prefix_counts, "prefix string, toxic_docs long, clean_docs long, toxic_uses long, clean_uses long")
    sums = counted.groupBy("prefix").agg(*[F.sum(c).alias(c) for c in ("toxic_docs", "clean_docs", "toxic_uses", "clean_uses")])
    a, c = F.col("toxic_docs"), F.col("clean_docs")
    share = lambda n, whole: F.when(n > 0, n * F.log(n / whole)).otherwise(F.lit(0.0))
    ea, ec = (a + c) * toxic / (toxic + clean), (a + c) * clean / (toxic + clean)
    g2 = 2 * (share(a, ea) + share(c, ec))
    weight = F.log(((F.col("toxic_uses") + 0.1) / toxic) / ((F.col("clean_uses") + 0.5) / clean))
    found = sums.filter(a >= LEAST_DOCS).select("prefix", weight.alias("weight"), g2.alias("g2")).filter((F.col("weight") > 1) & (F.col("g2") >= LEAST_G2))
    return {r["prefix"]: r["weight"] for r in found.orderBy(F.desc("g2"), "prefix").limit(MOST_PREFIXES).collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels)
    model = Model(learn_prefixes(sample))
    if not model.prefixes:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "weight", "x"])

    # nine numbers for each row of the bounded sample
    rows = common.map_arrow(sample.select("toxic", "weight", "text"), run, "toxic boolean, weight double, x array<double>").collect()
    x = np.asarray([r["x"] for r in rows])
    y, w = np.asarray([r["toxic"] for r in rows], float), np.asarray([r["weight"] for r in rows])
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of rows
    x, y, w = x[order], y[order], w[order]
    model.center, model.scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - model.center) / model.scale])
    beta, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = beta.tolist()
    return model


def score_toxicity(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``toxicity``, from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_PREFIXES prefixes

    def make():
        score = shared.value.score
        return lambda texts: [[score(t.decode()) for t in texts]]

    return common.map_text(df, text, keep, [("toxicity", T.DoubleType())], make)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
