"""Incremental ingestion and live statistics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_stream(texts: DataFrame, index, checkpoint: str, once: bool = True, rebuild: bool = True) -> StreamingQuery:
    """Feeds a stream of (source, text) rows into an index batch by batch; the last text of a source in a batch wins.

    Without `rebuild` only chunks and vectors are kept up to date; the graph waits for `index.rebuild()`.

    A repeated batch after a failure gives the same index, since sources are replaced.
    """

    def feed(batch: DataFrame, number: int) -> None:
        last = batch.withColumn("_n", F.monotonically_increasing_id()).groupBy("source").agg(F.max_by("text", "_n").alias("text"))
        if not last.isEmpty():
            index.ingest(last, rebuild=rebuild)

    writer = texts.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): events by time window and type; rows later than `late` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over the parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)
