"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; what it returns is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.

Defined results: null and empty texts are not toxic unless the labels make texts
without hits so, have no near-duplicates, no benchmark windows and no secrets, and
have no ids; texts of any length go through every stage whole. Of near-duplicates
the least id stays. Documents without an id all stay in that stage if one of them
would, as nothing tells them apart; rows that repeat an id and a text become one.
An empty table gives an empty one. Other columns pass through all stages but the last,
which gives the id, language, source and length beside the ids of tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, common, decontam, neardup, secrets, toxicity

#: Likeness of five-word shingles from which documents are near-duplicates.
NEAR = (80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; learned from the labels of these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = common.free_name(docs, "toxicity")
    return toxicity.score_toxicity(docs, model).filter(F.col(name) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each near-duplicate group, at a likeness of 0.8 or more."""
    kept = neardup.near_duplicates(docs, threshold=NEAR).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    name = common.free_name(docs, "hits")
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size(f"{name}.spans") == 0).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and ``n_chars`` counted again."""
    name = common.free_name(docs, "secret_spans")
    ledger = secrets.BlobLedger(spark, common.fresh_path(spark, "ledger"))
    clean = secrets.redact(secrets.scan_secrets(docs, ledger), name)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digests of ids and of what they decode to."""
    path = public_tokenizers.path(bpe.MULTI_50K)
    decoded = bpe.decode(bpe.encode(docs, path, keep=["doc_id", "lang", "source", "n_chars"]), path)
    return decoded.select("doc_id", "lang", "source", "n_chars", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", tokenise),
]

#: A learned score, sketches and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
