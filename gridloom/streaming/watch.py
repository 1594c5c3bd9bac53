"""Continuous ingestion of dropped scene files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, dead_letters: str, pattern: str = "*.parquet", once: bool = False) -> StreamingQuery:
    """Runs handle on every batch of new files under folder, each file once, across restarts.

    A batch that handle rejects goes to dead_letters with its error instead of being taken as done."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception as e:  # whatever a handler raises is kept with its batch
            batch.withColumns({"error": F.lit(str(e)[:2000]), "batch": F.lit(number)}).write.mode("append").parquet(dead_letters)

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(folder)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """w_start, event_type, n, total of events (ts, event_type, value) in tumbling windows with a watermark; for streams and tables."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    got = w.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("w_start"), "event_type", "n", "total")
