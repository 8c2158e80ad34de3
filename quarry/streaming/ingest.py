"""Incremental ingestion as a stream: new texts are added once, by content; events are counted in windows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import content_hash


def upsert_texts(spark: SparkSession, folder: str, table: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Append the texts of newly arrived Parquet files to a table, each content once. A repeated batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("content_hash", content_hash(F.col("text"))).dropDuplicates(["content_hash"])
        if os.path.exists(os.path.join(table, "_SUCCESS")):
            new = new.join(batch.sparkSession.read.parquet(table).select("content_hash"), "content_hash", "left_anti")
        new.write.mode("append").parquet(table)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, event_type, n, total) of a stream or table of events with ts, event_type, value."""
    w = F.window(F.col("ts").cast("timestamp"), window)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(w.alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
