"""Structured Streaming over arriving page outcomes: deduplicated ingest, event-time windows, idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import write_table


def arriving(spark: SparkSession, path: str, schema, late: str = "90 days", key: str = "out_id") -> DataFrame:
    """Rows of files that arrive under path, repeated ids within the watermark dropped."""
    got = spark.readStream.schema(schema).parquet(path).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return got.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark([key])


def windows(df: DataFrame, width: str = "1 day", *by: str) -> DataFrame:
    """Pages and text length of each window of event time; for streams and tables alike."""
    got = df.groupBy(F.window("ingested_at", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce(F.length("markdown"), F.lit(0))).alias("chars"))
    return got.select(F.col("w.start").alias("start"), *by, "pages", "chars")


def write_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch into a folder of its own: a repeated batch replaces its folder, so rows are written once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        write_table(batch.withColumn("batch", F.lit(batch_id)), path, "batch", mode="overwrite")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
