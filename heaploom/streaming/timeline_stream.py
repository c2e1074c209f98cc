"""Allocation timelines of running programs as Structured Streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allocation_windows(allocations: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Objects and bytes per window of ``ts``; ``allocations`` is a stream of ts, class_name, self_size.

    State is one row per window and class, and goes once the watermark has passed it.
    """
    timed = allocations.where("self_size > 0").withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", every), "class_name").agg(F.count(F.lit(1)).alias("count"), F.sum("self_size").alias("size"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "class_name", "count", "size")


def first_seen(objects: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each object of a stream of snapshots once: ts, id, class_name, self_size; state is bounded by the watermark."""
    return objects.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
