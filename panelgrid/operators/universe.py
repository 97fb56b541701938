"""Who may be traded when: membership intervals and tradability masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import by_name, require_columns


@dataclass(frozen=True)
class TradabilityRules:
    """None turns a rule off."""

    min_listed: int | None = 60
    require_volume: bool = True
    limit: float | None = 0.095


def membership_mask(grid: DataFrame, intervals: DataFrame) -> DataFrame:
    """grid with the column member: whether some closed interval (instrument, start, end) holds the date.

    Intervals are merged with the grid's dates in one pass over each instrument: the latest end of the
    intervals begun so far decides. So any number of intervals costs one sort, not a range join."""
    marks = intervals.select("instrument", F.col("start").alias("datetime"), F.lit(0).alias("_kind"), F.col("end").alias("_end")).where("datetime <= _end")
    both = grid.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    so_far = Window.partitionBy("instrument").orderBy("datetime", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_reach", F.max("_end").over(so_far)).where("_kind = 1")
    return seen.withColumn("member", F.coalesce(F.col("_reach") >= F.col("datetime"), F.lit(False))).drop("_kind", "_end", "_reach")


def listing_dates(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("instrument").agg(F.min("start").alias("listed"))


def tradability_mask(grid: DataFrame, *, intervals: DataFrame | None = None, rules: TradabilityRules = TradabilityRules()) -> DataFrame:
    """Dense grid with close and volume -> with the column tradable: close present, volume positive,
    enough closes observed so far, a member, and not moved by the limit since the previous date."""
    require_columns(grid, ["datetime", "instrument", "pos", "close", "volume"])
    out = membership_mask(grid, intervals) if intervals is not None else grid
    ok = F.col("close").isNotNull()
    if rules.require_volume:
        ok = ok & F.coalesce(F.col("volume") > 0, F.lit(False))
    if rules.min_listed is not None:
        ok = ok & (F.count("close").over(by_name().rowsBetween(Window.unboundedPreceding, 0)) >= rules.min_listed)
    if intervals is not None:
        ok = ok & F.col("member")
    if rules.limit is not None:
        before = F.lag("close").over(by_name())
        # a move from 0 is beyond any limit; without a previous close there is no move
        locked = F.when(before == 0, F.col("close") != 0).otherwise(F.abs(F.col("close") / F.nullif(before, F.lit(0.0)) - 1) >= rules.limit)
        ok = ok & ~F.coalesce(locked, F.lit(False))
    out = out.withColumn("tradable", F.coalesce(ok, F.lit(False)))
    return out.drop("member") if intervals is not None else out
