"""Streaming extension: category counts per window with a watermark, for a stability index as events come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window and event_type of a (streaming) frame; state is dropped once the watermark passes a window."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("at", ts).withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def psi_per_window(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """Stability index of each window's counts against reference shares (event_type, p)."""
    total = counts.groupBy("start").agg(F.sum("n").alias("t"))
    grid = total.crossJoin(F.broadcast(reference))
    both = grid.join(counts, ["start", "event_type"], "left")
    q, p = F.greatest(F.coalesce(F.col("n"), F.lit(0)) / F.col("t"), F.lit(1e-6)), F.greatest("p", F.lit(1e-6))
    return both.groupBy("start").agg(F.round(F.sum((q - p) * F.log(q / p)), 6).alias("psi"))
