"""Models as injected callables: entities, relations, classes, tokens.

A model is any picklable callable over a list of texts; it runs in Arrow batches,
once for a batch and never for a row. ``load`` in the wrappers is called once in a
task, so weights are read there. A batch that fails, or whose answer has another
length, leaves empty lists and its reason in ``error``; it never stops a job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions import text
from corpusforge.operators import entities
from corpusforge.session import ship


class EntityModel(Protocol):
    def __call__(self, texts: Sequence[str], labels: Sequence[str]) -> list[list[dict]]: ...


class Classifier(Protocol):
    def __call__(self, texts: Sequence[str], labels: Sequence[str]) -> list[dict[str, float]]: ...


@dataclass
class DictionaryModel:
    """Whole words of a list, as entities of their kind: a stand-in, and a test double."""

    words: dict[str, str]
    score: float = 1.0

    def __call__(self, texts: Sequence[str], labels: Sequence[str]) -> list[list[dict]]:
        import re

        kept = set(labels)
        return [[{"name": w, "type": self.words[w.lower()], "score": self.score} for w in re.findall(r"\w+", t or "") if self.words.get(w.lower()) in kept] for t in texts]


@dataclass
class KeywordClassifier:
    """The share of a label's keywords that a text holds."""

    keywords: dict[str, list[str]]

    def __call__(self, texts: Sequence[str], labels: Sequence[str]) -> list[dict[str, float]]:
        found = []
        for t in texts:
            words = set((t or "").lower().split())
            found.append({label: sum(k in words for k in self.keywords[label]) / len(self.keywords[label]) for label in labels if self.keywords.get(label)})
        return found


_ENTITY = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("score", T.DoubleType())])
_CLASS = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])


def _answered(model, texts: list, labels: list[str], size: int) -> tuple[list, list]:
    """Answers and errors for each text, in the model's own batches."""
    answers, errors = [], []
    for at in range(0, len(texts), size):
        part = texts[at : at + size]
        try:
            got = list(model(part, labels))
            if len(got) != len(part):
                raise ValueError(f"{len(got)} answers for {len(part)} texts")
            answers, errors = answers + got, errors + [None] * len(part)
        except Exception as e:  # whatever a model raises is reported, not propagated
            answers, errors = answers + [[] for _ in part], errors + [f"{type(e).__name__}: {e}"] * len(part)
    return answers, errors


def model_entities(chunks: DataFrame, load: Callable[[], EntityModel], labels: list[str], threshold: float = 0.5, key: str = "chunk_id", column: str = "text", batch: int = 16, regex: bool = True) -> DataFrame:
    """(key, name, type, normalized_name, score): a model's entities over windows, and the patterns'.

    Long texts are read in overlapping windows; what is long or below the threshold
    goes; the best of each type and normal form stays, the first of equals.
    """
    ship(chunks.sparkSession)
    parts = chunks.select(F.col(key), F.posexplode(text.windows(column)).alias("w", "_part"))
    kind = dict(chunks.dtypes)[key]

    def run(frames):
        model = load()
        for pdf in frames:
            found, _ = _answered(model, pdf["_part"].tolist(), labels, batch)
            rows = [(k, 1000 * w + i, e["name"], e["type"], float(e["score"])) for k, w, es in zip(pdf[key], pdf["w"], found, strict=True) for i, e in enumerate(es)]
            yield pd.DataFrame(rows, columns=[key, "pos", "name", "type", "score"])

    found = parts.mapInPandas(run, f"{key} {kind}, pos long, name string, type string, score double").filter(F.col("score") >= threshold)
    found = entities.clean_model_entities(found).withColumn("normalized_name", text.normalize_entity("name"))
    columns = [key, "name", "type", "normalized_name", "score", "pos"]
    if regex:
        by_rule = chunks.select(key, F.posexplode(entities.pattern_entities(column)).alias("pos", "e")).select(key, "e.name", "e.type", "e.normalized_name", "e.score", (F.col("pos") + 10**9).cast("long").alias("pos"))
        found = found.select(columns).unionByName(by_rule.select(columns))
    return entities.dedupe_entities(found, key).select(columns[:-1])


def classify(rows: DataFrame, load: Callable[[], Classifier], labels: list[str], threshold: float = 0.5, column: str = "text", batch: int = 16) -> DataFrame:
    """rows with ``classes`` (label, score), best first, and ``error``."""
    ship(rows.sparkSession)
    out = T.StructType([*rows.schema.fields, T.StructField("classes", T.ArrayType(_CLASS)), T.StructField("error", T.StringType())])

    def run(frames):
        model = load()
        for pdf in frames:
            found, errors = _answered(model, pdf[column].tolist(), labels, batch)
            kept = [sorted(({"label": k, "score": float(v)} for k, v in dict(f).items() if v >= threshold), key=lambda c: (-c["score"], c["label"])) for f in found]
            yield pdf.assign(classes=kept, error=errors)

    return rows.mapInPandas(run, out)


def tokenise(c: str | Column) -> Column:
    """The default tokenizer: words and single marks."""
    return entities.word_tokens(c)


def detokenise(c: str | Column) -> Column:
    """Tokens as a text, with no space before closing marks."""
    return F.regexp_replace(F.array_join(text.col(c), " "), r" ([.,;:!?)\]}])", "$1")
