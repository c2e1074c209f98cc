"""Positions and the scopes that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_enclosing(points: DataFrame, scopes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """For each ``pos`` the narrowest scope with start <= pos < end, among those of its ``group``.

    Every scope is put into the one level of cells wider than itself, which it meets in two
    cells at most; a position asks one cell per level that occurs. So the join is on equal
    cells, and no pair is compared that does not share one.
    """
    group = group or []
    width = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    level = F.ceil(F.log2(width.cast("double"))).cast("int")
    cell = lambda x, lv: F.call_function("shiftright", x.cast("long"), lv)
    cut = scopes.where("end > start").withColumn("_level", level)
    cut = cut.withColumn("_cell", F.explode(F.sequence(cell(F.col("start"), F.col("_level")), cell(F.col("end") - 1, F.col("_level")))))
    levels = [r[0] for r in cut.select("_level").distinct().collect()]
    asked = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]) if levels else F.array().cast("array<int>"))).withColumn("_cell", cell(F.col("pos"), F.col("_level")))
    held = asked.join(cut, [*group, "_level", "_cell"]).where("pos >= start and pos < end")
    return held.groupBy(*points.columns).agg(F.min_by("scope", F.struct((F.col("end") - F.col("start")).alias("w"), "scope")).alias("scope"))
