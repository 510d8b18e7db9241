"""Streams of changes: scoring that resumes, and labels joined as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(changes: DataFrame, score: Callable[[DataFrame], DataFrame], identity: str, time: str, sink: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Score every change of a stream once and append to sink.

    Repeated deliveries within the watermark are dropped; the checkpoint makes a
    restart go on where it stopped, and the file sink commits each batch once.
    """
    fresh = changes.withWatermark(time, late).dropDuplicatesWithinWatermark([identity])
    return score(fresh).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def labels_in_time(predictions: DataFrame, labels: DataFrame, identity: str, predicted_at: str, available_at: str, wait: str = "30 days") -> DataFrame:
    """Predictions joined to the labels that became available within wait after
    them; both watermarked, so state older than the wait is dropped.  A label
    from before its prediction doesn't count."""
    p = predictions.withWatermark(predicted_at, "1 hour").alias("p")
    y = labels.withColumnRenamed(identity, "__id").withWatermark(available_at, "1 hour").alias("y")
    within = (F.col(identity) == F.col("__id")) & (F.col(available_at) >= F.col(predicted_at)) & (F.col(available_at) <= F.col(predicted_at) + F.expr(f"interval {wait}"))
    return p.join(y, within).drop("__id")


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, kind, n) per tumbling window, closed once the watermark is past."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
