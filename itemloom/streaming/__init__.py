"""Structured Streaming over heartbeats and jobs: an extension, with the rules of the batch operators.

A heartbeat is (key, ts). Late ones change nothing once the watermark has passed their window; state is one row a key and window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def heartbeats(stream: DataFrame, key: str, ts: str, window: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """key, window_start, window_end, last_seen, n: tumbling windows with a watermark, so old state is dropped."""
    w = F.window(ts, window)
    d = stream.withWatermark(ts, late).groupBy(F.col(key), w.alias("w")).agg(F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return d.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "last_seen", "n")


def distinct_events(stream: DataFrame, key: list[str], ts: str, late: str = "30 minutes") -> DataFrame:
    """Each event once, whatever was sent twice, with state bounded by the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def leases(beats: DataFrame, key: str, now: str, seconds: int = 300) -> DataFrame:
    """key, last_seen, expired from (key, last_seen) rows of any number of windows; the time is a parameter. For batches."""
    d = beats.groupBy(key).agg(F.max("last_seen").alias("last_seen"))
    return d.withColumn("expired", F.col("last_seen") + F.expr(f"INTERVAL {seconds} SECONDS") <= F.lit(now).cast("timestamp"))


def recover(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], interrupted: str, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch's interrupted jobs to *handle(jobs, batch_id)*. A batch may come again after a crash with the same id, so
    *handle* must be idempotent (as ``generations.publish`` with ``expected`` is)."""

    def each(batch: DataFrame, number: int) -> None:
        jobs = batch.filter(interrupted)
        if not jobs.isEmpty():
            handle(jobs, number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
