"""Streams with state per instrument: publication of late values that expire, rolling scores, and sessions.

State is kept per instrument and only for what is still open: events whose day hasn't closed yet, and the value or the
last few values that later days need. A calendar day closes when the watermark passes its end; a timer then emits
its rows, once, so no batch reads an earlier batch again. Rows later than the watermark allows are left out, as
everywhere in Structured Streaming. Needs the RocksDB state store, which use_state_store() sets.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from statistics import fmean, stdev

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from panelgrid.operators.pit import LagSpec

_EPOCH, _DAY_MS = date(1970, 1, 1), 86_400_000


def use_state_store(spark: SparkSession) -> None:
    """State with timers is kept in RocksDB, on the executors' disks with a changelog beside the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Calendar:
    """Trading days by position. It is bounded by its nature (thousands of days), so every task may hold it."""

    def __init__(self, days: Sequence[date]):
        self.days = sorted({(d - _EPOCH).days for d in days})

    def __len__(self) -> int:
        return len(self.days)

    def first(self, day: int) -> int:
        """Position of the first trading day on or after a day (counted from 1970)."""
        return bisect.bisect_left(self.days, day)

    def end_ms(self, pos: int) -> int:
        return (self.days[pos] + 1) * _DAY_MS

    def closed(self, watermark_ms: int) -> int:
        """How many trading days have ended by the watermark."""
        return bisect.bisect_right(self.days, watermark_ms // _DAY_MS - 1)

    def date(self, pos: int) -> date:
        return _EPOCH + timedelta(self.days[pos])


def _none(x) -> float | None:
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)


def _days(column: pd.Series) -> list[int]:
    return [(d - _EPOCH).days for d in column]


class _ByDay(StatefulProcessor):
    """Keeps rows until their trading day closes, then has on_day() called for each closed day in order."""

    pending_schema: str

    def __init__(self, calendar: Calendar):
        self.calendar = calendar

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.pending_schema)
        self.done = handle.getValueState("done", "pos bigint")

    def keep(self, rows: list[tuple]) -> None:
        """rows: tuples that begin with the position of their trading day."""
        rows = [r for r in rows if r[0] < len(self.calendar)]
        if rows:
            self.pending.appendList(rows)
            for pos in {r[0] for r in rows}:
                self.handle.registerTimer(self.calendar.end_ms(pos))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = self.calendar.closed(timerValues.getCurrentWatermarkInMs())
        done = self.done.get()[0] if self.done.exists() else 0
        if done >= closed:  # another timer of this batch has brought this one's days
            return
        waiting = sorted(self.pending.get(), key=lambda r: r[0]) if self.pending.exists() else []
        begin = max(done, min([self.calendar.closed(expiredTimerInfo.getExpiryTimeInMs()) - 1, *[r[0] for r in waiting[:1]]]))
        due = bisect.bisect_left(waiting, closed, key=lambda r: r[0])
        made, on = self.on_days(key, begin, closed, waiting[:due])
        self.pending.clear()
        if waiting[due:]:
            self.pending.put(waiting[due:])
        if on and closed < len(self.calendar):
            self.handle.registerTimer(self.calendar.end_ms(closed))
        self.done.update((closed,))
        if not on and not waiting[due:]:
            self.done.clear()  # nothing of this instrument is open: all its state has expired
        if made:
            yield pd.DataFrame(made, columns=self.columns)

    def close(self) -> None:
        pass


class _Publisher(_ByDay):
    """The event seen last, on each day until it is stale."""

    def __init__(self, calendar: Calendar, values: Sequence[str], max_periods: int | None, max_days: int | None):
        super().__init__(calendar)
        self.values, self.max_periods, self.max_days = list(values), max_periods, max_days
        self.pending_schema = "pos bigint, visible bigint, report bigint, " + ", ".join(f"`{v}` double" for v in values)
        self.columns = ["datetime", "pos", "instrument", *self.values]

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", self.pending_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            visible, values = _days(part["visible"]), [[_none(x) for x in part[v]] for v in self.values]
            reports = [-(10**6) if pd.isna(d) else (d - _EPOCH).days for d in part["report"]]
            self.keep(list(zip(map(self.calendar.first, visible), visible, reports, *values, strict=True)))
        return iter(())

    def _stale(self, event: tuple, pos: int) -> bool:
        late = self.max_periods is not None and pos >= event[0] + self.max_periods
        return late or (self.max_days is not None and pos >= self.calendar.first(event[1] + self.max_days + 1))

    def on_days(self, key, begin: int, closed: int, events: list[tuple]) -> tuple[list[tuple], bool]:
        last, made, at = self.last.get() if self.last.exists() else None, [], 0
        order = lambda e: (e[1], e[2], [(v is not None, v or 0.0) for v in e[3:]])
        for pos in range(begin, closed):
            while at < len(events) and events[at][0] <= pos:
                if last is None or order(events[at]) >= order(last):
                    last = events[at]
                at += 1
            if last is not None and self._stale(last, pos):
                last = last if last[0] > pos else None
            if last is not None:
                made.append((self.calendar.date(pos), pos, key[0], *last[3:]))
        if last is None:
            self.last.clear()
        else:
            self.last.update(tuple(last))
        return made, last is not None


def publish_stream(events: DataFrame, days: Sequence[date], spec: LagSpec, *, late: str = "0 days", max_periods: int | None = None, max_days: int | None = None) -> DataFrame:
    """The rows of pit.publish by announcement, emitted when each day closes: events may come ``late`` behind the newest one
    and in any order; one that is newer replaces what it corrects from its day on; a value ends by timer when it is stale."""
    visible, report = F.col(spec.announce).cast("date"), F.col(spec.report).cast("date")
    checked = F.when(F.datediff(visible, report) < 0, F.raise_error(F.lit("announced before the report date"))).otherwise(visible) if not spec.allow_negative_lag else visible
    rows = events.select(F.col(spec.instrument).alias("instrument"), checked.alias("visible"), report.alias("report"), *[F.expr(f"try_cast(`{v}` AS DOUBLE)").alias(v) for v in spec.values]).where("visible is not null")
    kind = events.schema[spec.instrument].dataType.simpleString()
    seen = rows.withColumn("_at", F.col("visible").cast("timestamp")).withWatermark("_at", late)
    processor = _Publisher(Calendar(days), spec.values, max_periods, max_days)
    schema = f"datetime date, pos bigint, instrument {kind}, " + ", ".join(f"`{v}` double" for v in spec.values)
    return seen.groupBy("instrument").transformWithStateInPandas(processor, schema, "Append", "EventTime")


class _Ring(_ByDay):
    """z-score of a day's total against the totals of the days before it, of which only the last few are kept."""

    pending_schema = "pos bigint, x double"
    columns = ["datetime", "pos", "instrument", "x", "z"]

    def __init__(self, calendar: Calendar, length: int, min_periods: int):
        super().__init__(calendar)
        self.length, self.min_periods = length, min_periods

    def init(self, handle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", self.pending_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.keep(list(zip(map(self.calendar.first, _days(part["day"])), map(_none, part["x"]), strict=True)))
        return iter(())

    def on_days(self, key, begin: int, closed: int, events: list[tuple]) -> tuple[list[tuple], bool]:
        ring, made = [tuple(r) for r in self.ring.get()] if self.ring.exists() else [], []
        for pos in sorted({r[0] for r in events}):
            own = [r[1] for r in events if r[0] == pos and r[1] is not None]
            x = math.fsum(own) if own else None
            ring = [r for r in ring if r[0] >= pos - self.length]
            past = [r[1] for r in ring]
            deviation = stdev(past) if len(past) >= max(self.min_periods, 2) else 0.0
            made.append((self.calendar.date(pos), pos, key[0], x, (x - fmean(past)) / deviation if x is not None and deviation else None))
            if x is not None:
                ring.append((pos, x))
        # what no later day can look back to has expired
        ring = [r for r in ring if r[0] >= closed - self.length]
        self.ring.clear()
        if ring:
            self.ring.put(ring)
        return made, bool(ring)


def roll_z_stream(events: DataFrame, days: Sequence[date], *, length: int, min_periods: int, ts: str = "ts", name: str = "user_id", value: str = "value", late: str = "2 days") -> DataFrame:
    """(datetime, pos, instrument, x, z): of each day with events its total and the score that normalize.roll_z gives it on the
    dense panel. Rows of a day may come in any order until it closes."""
    kind = events.schema[name].dataType.simpleString()
    seen = events.where(F.col(ts).isNotNull()).select(F.col(name).alias("instrument"), F.to_date(ts).alias("day"), F.col(value).cast("double").alias("x"), F.col(ts).alias("_at")).withWatermark("_at", late)
    return seen.groupBy("instrument").transformWithStateInPandas(_Ring(Calendar(days), length, min_periods), f"datetime date, pos bigint, instrument {kind}, x double, z double", "Append", "EventTime")


def session_stream(events: DataFrame, gap: str, *, ts: str = "ts", name: str = "user_id", value: str = "value", late: str = "2 days") -> DataFrame:
    """(instrument, start, last, n, total): sessions of rows of an instrument with no more than ``gap`` between neighbours,
    emitted when the watermark has passed their end."""
    windows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(name).alias("instrument"))
    return windows.agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("instrument", "start", "last", "n", "total")


def sessions(events: DataFrame, gap: str, *, ts: str = "ts", name: str = "user_id", value: str = "value") -> DataFrame:
    """The same of a whole table, by gaps and islands: a row that comes more than ``gap`` after the one before begins a session."""
    order = Window.partitionBy(name).orderBy(ts)
    begins = F.coalesce(F.col(ts) > F.lag(ts).over(order) + F.expr(f"interval {gap}"), F.lit(True))
    numbered = events.where(F.col(ts).isNotNull()).withColumn("_new", begins).withColumn("_session", F.sum(F.col("_new").cast("bigint")).over(order))
    return numbered.groupBy(F.col(name).alias("instrument"), "_session").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).drop("_session")
