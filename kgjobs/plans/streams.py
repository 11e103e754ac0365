"""The streams, run over all there is of a driver table; they must give the rows of the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..adapters import FEEDBACK
from ..queries import SQL, query, rounded


def stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """The table's files as a stream; the path is a pattern, as a stream takes a single file by pattern only."""
    schema = spark.read.parquet(f"{d}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{d}/{table}.parque[t]")


def feedback_stream(spark: SparkSession, d: str) -> DataFrame:
    return stream(spark, d, "events").selectExpr(*FEEDBACK).withColumn("ts", F.col("ts").cast("timestamp"))


@query(SQL["feedback_stats"])
def stream_feedback_stats(spark, d):
    with streaming.keep_state_on_disk(spark):
        s = streaming.settle(streaming.feedback_counters(feedback_stream(spark, d)), ["rule_id"])
    return s.withColumn("last_us", F.unix_micros("last_feedback_at")).drop("last_feedback_at")


@query(SQL["sliding_confidence"])
def stream_sliding_confidence(spark, d):
    e = feedback_stream(spark, d).select("rule_id", F.col("event_id").alias("seq"), F.col("positive").alias("passed"), F.lit("h").alias("hash"))
    return rounded(streaming.settle(streaming.sliding_confidence(e), ["rule_id"]), "multiplier")


@query("select doc_id as id, case when doc_id % 10 = 0 then 'new' when doc_id % 10 = 1 then 'changed' else 'unchanged' end as status from documents")
def stream_incremental_ingest(spark, d):
    hashed = lambda docs: docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    manifest = hashed(spark.read.parquet(f"{d}/documents.parquet")).where("id % 10 <> 0").withColumn("hash", F.when(F.col("id") % 10 == 1, "old").otherwise(F.col("hash")))
    return streaming.incremental_ingest(hashed(stream(spark, d, "documents")), manifest)
