"""A folder of documents as a stream of ingested chunks.

A checkpoint takes the place of claiming jobs: each micro-batch holds the files
that no earlier one did. Writing a batch replaces its files in a store of buckets,
in one version that also notes the batch as done, so a batch that runs twice is
written once, and one of a single file writes a single bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusforge.plans import ingest
from corpusforge.sources.files import line_chunks


def ingest_batch(docs: DataFrame, out: str, stream: str | None = None, batch: int | None = None) -> None:
    """Chunk, enrich and upsert the documents of one batch."""
    chunks = line_chunks(docs).withColumn("headings", F.array().cast("array<string>"))
    ingest.upsert(ingest.enrich(chunks), out, stream=stream, batch=batch)


def stream_documents(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, per_batch: int | None = None) -> StreamingQuery:
    """Ingest all files there are now, in batches, and stop."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    stream = reader.parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: ingest_batch(df, out, checkpoint, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_stale(jobs: DataFrame, seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Windows of (file_id, window) in which a file's job stayed in process, from a stream of job events (ts, file_id, status)."""
    w = F.window("ts", f"{seconds} seconds")
    seen = jobs.withWatermark("ts", lateness).groupBy(w, "file_id").agg(F.count_if(F.col("status") == "PROCESSING").alias("began"), F.count_if(F.col("status").isin("COMPLETED", "FAILED")).alias("ended"))
    return seen.filter((F.col("began") > 0) & (F.col("ended") == 0)).select("window.start", "window.end", "file_id")
