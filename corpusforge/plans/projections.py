"""The driver's tables in the roles of the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.sources.files import line_chunks

STATUS_OF = {"signup": "PENDING", "view": "PROCESSING", "purchase": "COMPLETED", "error": "FAILED", "click": "EXCLUDED"}


#: Tables of long texts.
TEXTS = {"documents", "pages"}


class Tables:
    """Lazily read and projected tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        """The table; texts that one task would read alone are dealt over all cores first.

        Spark reads a row group in one task, and work on texts is far dearer than
        to move them. What is moved is at most one split, whatever the cluster.
        """
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name in TEXTS and cores > 1 and self._is_one_split(df) else df

    def _is_one_split(self, df: DataFrame) -> bool:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(size)) <= int(self.spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB"))

    def chunks(self) -> DataFrame:
        """(file_id, chunk_index, text, body_hash): the lines of documents."""
        return line_chunks(self.read("documents")).withColumn("body_hash", text.body_hash("text"))

    def jobs(self) -> DataFrame:
        """Events as jobs: user = file, kind = status, time = creation."""
        status = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
        e = self.read("events")
        return e.select(
            F.col("event_id").alias("job_id"),
            F.col("user_id").alias("file_id"),
            F.element_at(status, F.col("event_type")).alias("status"),
            F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            F.col("value"),
        )

    def points(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("category"))

    def mentions(self) -> DataFrame:
        """Orders mention parts; a discount is what a mention's score lacks to 1."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"), (1 - 5 * F.col("l_discount")).alias("score"))

    def relations(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_suppkey").alias("head_id"), F.col("l_returnflag").alias("rel_type"), F.col("l_partkey").alias("tail_id"), F.col("l_orderkey").alias("file_id"), (1 - 5 * F.col("l_discount")).alias("score"))

    def turns(self) -> DataFrame:
        return self.read("conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk_index"), "text", "role")
