"""As-of publication of late data: a value is visible from the day it was announced, not from the period it is about."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import calendar, require_columns, spread


@dataclass(frozen=True)
class LagSpec:
    """Names of an event table's columns."""

    values: tuple[str, ...]
    instrument: str = "instrument"
    report: str = "report_date"
    announce: str = "announce_date"
    allow_negative_lag: bool = False


def _visible(spec: LagSpec, mode: str, allow_leaky: bool) -> str:
    if mode == "announcement":
        return spec.announce
    if mode != "report_date":
        raise ValueError(f"unknown mode {mode!r}")
    if not allow_leaky:
        raise ValueError("publishing by report date leaks; pass allow_leaky=True for a negative control")
    return spec.report


def negative_lags(events: DataFrame, spec: LagSpec) -> DataFrame:
    """Events announced before the period that they report."""
    return events.where(F.datediff(spec.announce, spec.report) < 0)


def _events(events: DataFrame, spec: LagSpec, column: str) -> DataFrame:
    require_columns(events, [spec.instrument, spec.report, spec.announce, *spec.values])
    return events.select(F.col(spec.instrument).alias("instrument"), F.col(column).cast("date").alias("visible"), F.col(spec.report).cast("date").alias("report"), *[F.expr(f"try_cast(`{v}` AS DOUBLE)").alias(v) for v in spec.values]).where("visible is not null")


def _numbered(days: DataFrame) -> DataFrame:
    return days if "pos" in days.columns else calendar(days)


def positions(df: DataFrame, days: DataFrame, date: str, out: str) -> DataFrame:
    """Adds the position of the first trading day on or after a date: the calendar's length if there is none. Every day of the
    calendar's range has a row with its position, so a date is looked up by one equality, whatever the calendar's length; the range is
    some ten thousand rows for a lifetime, and broadcast."""
    order = Window.orderBy("datetime")
    gaps = days.select("datetime", F.col("pos").alias(out), F.coalesce(F.date_add(F.lag("datetime").over(order), 1), F.col("datetime")).alias("_from"))
    each = gaps.select(out, F.explode(F.sequence("_from", "datetime")).alias("_day"))
    ends = days.agg(F.min("datetime").alias("_first"), F.count(F.lit(1)).alias("_length"))  # one row
    found = df.join(F.broadcast(each), F.col(date) == F.col("_day"), "left").crossJoin(F.broadcast(ends))
    place = F.coalesce(F.col(out), F.when(F.col(date) < F.col("_first"), F.lit(0)).otherwise(F.col("_length")))
    return found.withColumn(out, place.cast("bigint")).drop("_day", "_first", "_length")


def publish(events: DataFrame, days: DataFrame, spec: LagSpec, *, mode: str = "announcement", allow_leaky: bool = False, max_periods: int | None = None, max_days: int | None = None, rows: int | None = None) -> DataFrame:
    """(datetime, pos, instrument, values): on each date the event seen last, as long as it isn't stale.

    max_periods counts trading days from the first on which the event is seen, max_days calendar days
    from its visibility. When a value expires a gap follows, even if an older one hasn't expired. Of
    events that become visible on one trading day the latest counts; ties go by report date, then values.
    rows: how many to spread over tasks, if known (of events, or with their publication for a verification beside it); else events are counted.
    """
    column = _visible(spec, mode, allow_leaky)
    if not spec.allow_negative_lag and (bad := negative_lags(events, spec).limit(5).collect()):
        raise ValueError(f"announced before the report date: {bad}")
    order = Window.partitionBy("instrument").orderBy("visible", "report", *spec.values)
    days = _numbered(days)
    seen = spread(_events(events, spec, column), events.count() if rows is None else rows, "instrument")
    spans = positions(seen, days, "visible", "start")
    if max_days is not None:
        spans = positions(spans.withColumn("_until", F.date_add("visible", max_days + 1)), days, "_until", "_old").drop("_until")
    spans = spans.crossJoin(F.broadcast(days.agg(F.count(F.lit(1)).alias("_end"))))  # one row
    stop = F.coalesce(F.lead("start").over(order), F.col("_end"))
    if max_periods is not None:
        stop = F.least(stop, F.col("start") + max_periods)
    if max_days is not None:
        stop = F.least(stop, F.col("_old"))
    spans = spans.withColumn("stop", stop).where("stop > start")
    held = spans.select("instrument", *spec.values, F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
    return held.join(F.broadcast(days.select("pos", "datetime")), "pos").select("datetime", "pos", "instrument", *spec.values)


def verify(published: DataFrame, events: DataFrame, spec: LagSpec, *, mode: str = "announcement", allow_leaky: bool = True, rows: int | None = None) -> DataFrame:
    """Published rows that aren't the latest event visible on their date: none if all is well. Nulls equal nulls.

    rows: events and published rows to spread over tasks, if known; else both are counted."""
    rows = events.count() + published.count() if rows is None else rows
    seen = spread(_events(events, spec, _visible(spec, mode, allow_leaky)), rows, "instrument")
    # as-of join by one window over both, instead of a join of every date with all events before it
    marks = seen.select("instrument", F.col("visible").alias("day"), F.lit(0).alias("kind"), F.struct("report", *spec.values).alias("event"))
    asked = published.select("instrument", F.col("datetime").alias("day"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["event"].dataType).alias("event"), *[F.col(v).alias(f"got_{v}") for v in spec.values])
    both = spread(marks.unionByName(asked, allowMissingColumns=True), rows, "instrument")  # no shuffle if both are spread already
    upto = Window.partitionBy("instrument").orderBy("day", "kind", "event").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("latest", F.last("event", ignorenulls=True).over(upto)).where("kind = 1")
    close = lambda a, b: F.coalesce(F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b), a.isNull() & b.isNull())
    right = F.col("latest").isNotNull()
    for v in spec.values:
        right = right & close(F.col(f"got_{v}"), F.col(f"latest.{v}"))
    return found.where(~right).select(F.col("day").alias("datetime"), "instrument", *[F.col(f"got_{v}").alias(v) for v in spec.values])


def first_visible(events: DataFrame, days: DataFrame, spec: LagSpec) -> DataFrame:
    """(instrument, first_date): the first calendar date on or after the instrument's least announcement; null if none."""
    least = events.groupBy(F.col(spec.instrument).alias("instrument")).agg(F.min(F.col(spec.announce).cast("date")).alias("seen"))
    days = _numbered(days)
    placed = positions(least, days, "seen", "pos").withColumn("pos", F.when(F.col("seen").isNotNull(), F.col("pos")))
    return placed.join(F.broadcast(days.select("pos", F.col("datetime").alias("first_date"))), "pos", "left").select("instrument", "first_date")
