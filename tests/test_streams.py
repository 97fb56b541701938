"""Streams in several batches against one run over all their rows."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import grid, normalize, pit
from panelgrid.streaming import stateful

DAY = dt.date(2024, 3, 1)


def days_of(spark, n, step=1):
    dates = [DAY + dt.timedelta(step * i) for i in range(n)]
    return dates, grid.calendar(spark.createDataFrame([(d,) for d in dates], "datetime date"))


def run(spark, folder, frames, stream, out, schema):
    """Each frame is one file, and one batch; returns the sink's rows and the query's progress."""
    stateful.use_state_store(spark)
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/batch={k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = stream(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/at").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(out), [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in query.recentProgress]


EVENTS = "instrument string, report_date date, announce_date date, amount double"


def announcements(seed, n=60):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        told = DAY + dt.timedelta(int(k // 3 + r.integers(0, 2)))  # nearly in order, some a day back
        rows.append((f"n{r.integers(0, 4)}", told - dt.timedelta(int(r.integers(0, 9))), told, None if k % 11 == 0 else float(r.integers(0, 99))))
    return rows


@pytest.mark.parametrize("limits", [{}, {"max_periods": 3}, {"max_days": 4}])
def test_published_stream_is_one_publication(spark, tmp_path, limits):
    rows = announcements(5)
    dates, days = days_of(spark, 16, 2)
    spec = pit.LagSpec(values=("amount",))
    # two sentinels move the watermark past the calendar's end: batches don't close their own days
    end = [("z", dates[-1], dates[-1] + dt.timedelta(9), 0.0)]
    frames = [rows[:20], rows[20:40], rows[40:], end, end]
    got, _ = run(spark, str(tmp_path), frames, lambda s: stateful.publish_stream(s, dates, spec, late="3 days", **limits), f"{tmp_path}/out", EVENTS)
    # a row may come up to three days behind the newest: these all do
    want = pit.publish(spark.createDataFrame(rows + end, EVENTS), days, spec, **limits)
    key = lambda df: sorted((r.datetime, r.pos, r.instrument, -1.0 if r.amount is None else r.amount) for r in df.collect())
    assert key(got) == key(want) and got.count() > 20


def test_a_correction_counts_from_its_day_on(spark, tmp_path):
    dates, _ = days_of(spark, 6)
    spec = pit.LagSpec(values=("amount",))
    day = lambda k: DAY + dt.timedelta(k)
    frames = [[("a", day(0), day(1), 1.0)], [("a", day(0), day(3), 2.0), ("a", day(0), day(2), 7.0)], [("z", day(0), day(20), 0.0)], [("z", day(0), day(20), 0.0)]]
    got, _ = run(spark, str(tmp_path), frames, lambda s: stateful.publish_stream(s, dates, spec, late="2 days", max_periods=2), f"{tmp_path}/out", EVENTS)
    assert {(r.pos, r.amount) for r in got.collect()} == {(1, 1.0), (2, 7.0), (3, 2.0), (4, 2.0)}


def test_negative_lag_stops_the_stream(spark, tmp_path):
    dates, _ = days_of(spark, 3)
    with pytest.raises(Exception, match="before the report date"):
        run(spark, str(tmp_path), [[("a", DAY + dt.timedelta(2), DAY, 1.0)]], lambda s: stateful.publish_stream(s, dates, pit.LagSpec(values=("amount",))), f"{tmp_path}/out", EVENTS)


TICKS = "ts timestamp, user_id bigint, value double"


def ticks(seed, n=240, days=20):
    r = np.random.default_rng(seed)
    at = np.sort(r.integers(0, days * 24 * 60, n))
    return [(dt.datetime(2024, 3, 1) + dt.timedelta(minutes=int(m)), int(r.integers(0, 5)), None if k % 17 == 0 else float(r.integers(0, 50)) / 4) for k, m in enumerate(at)]


def shuffled_within(rows, size, seed):
    """Rows of neighbouring days change places, so batches hold late rows."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(0, len(rows), size):
        part = rows[k : k + size]
        out += [part[i] for i in r.permutation(len(part))]
    return out


def test_rolling_stream_is_the_batch_column(spark, tmp_path):
    rows = shuffled_within(ticks(3), 12, 4)
    dates, _ = days_of(spark, 20)
    end = [(dt.datetime(2024, 5, 1), 99, 1.0)]
    frames = [rows[:80], rows[80:160], rows[160:], end, end]
    got, _ = run(spark, str(tmp_path), frames, lambda s: stateful.roll_z_stream(s, dates, length=6, min_periods=3, late="3 days"), f"{tmp_path}/out", TICKS)
    events = spark.createDataFrame(rows, TICKS)
    daily = events.groupBy(F.to_date("ts").alias("datetime"), F.col("user_id").alias("instrument")).agg(F.sum("value").alias("x"))
    dense = grid.densify(daily, ["x"], days=grid.calendar(spark.createDataFrame([(d,) for d in dates], "datetime date")))
    want = normalize.roll_z(dense, "x", "z", length=6, min_periods=3).join(daily.select("datetime", "instrument"), ["datetime", "instrument"])
    near = lambda v: None if v is None else pytest.approx(v, abs=1e-9)
    assert {(r.datetime, r.instrument): (r.x, r.z) for r in got.collect()} == {(r.datetime, r.instrument): (near(r.x), near(r.z)) for r in want.collect()}
    assert got.where("z is not null").count() > 20


def test_sessions_of_a_stream_and_of_a_table(spark, tmp_path):
    rows = ticks(8, n=120, days=6)
    rows += [(rows[0][0] + dt.timedelta(hours=k), 77, 1.0) for k in (0, 3, 6, 8)] + [(rows[0][0] + dt.timedelta(hours=k, seconds=k % 2), 78, 1.0) for k in (0, 3, 9)]  # gaps of exactly three hours don't part a session
    end = [(dt.datetime(2024, 5, 1), 99, 1.0)]
    ordered = shuffled_within(sorted(rows, key=lambda r: r[0]), 10, 1)
    got, _ = run(spark, str(tmp_path), [ordered[:40], ordered[40:80], ordered[80:], end, end], lambda s: stateful.session_stream(s, "3 hours", late="2 days"), f"{tmp_path}/out", TICKS)
    table = stateful.sessions(spark.createDataFrame(rows, TICKS), "3 hours")
    key = lambda df: sorted((r.instrument, r.start, r["last"], r.n, -1.0 if r.total is None else r.total) for r in df.collect())
    assert key(got) == key(table)
    assert {i: [r.n for r in table.where(f"instrument = {i}").orderBy("start").collect()] for i in (77, 78)} == {77: [4], 78: [1, 1, 1]}


def test_no_batch_reads_an_earlier_one_and_state_expires(spark, tmp_path):
    rows = announcements(9)
    dates, _ = days_of(spark, 16, 2)
    end = [("z", dates[-1], dates[-1] + dt.timedelta(9), 0.0)]
    stream = lambda s: stateful.publish_stream(s, dates, pit.LagSpec(values=("amount",)), late="3 days", max_days=4)
    _, progress = run(spark, str(tmp_path), [rows[:20], rows[20:40], rows[40:], end, end], stream, f"{tmp_path}/out", EVENTS)
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [20, 20, 20, 1, 1]
