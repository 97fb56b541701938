import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelgrid.functions import tails
from panelgrid.operators import audit, grid, hac, ic, labels, normalize, pit, universe

DAY = dt.date(2020, 1, 1)


def panel(spark, values):
    rows = [(DAY + dt.timedelta(i), i, k, v) for k, xs in values.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "datetime date, pos bigint, instrument string, x double")


def test_rank_ties_and_nulls(spark):
    rows = [(DAY, 0, k, v) for k, v in zip("abcd", (1.0, 1.0, None, 5.0))]
    df = spark.createDataFrame(rows, "datetime date, pos bigint, instrument string, x double")
    got = {r.instrument: r.z for r in normalize.cs_rank(df, "x", "z").collect()}
    assert got == {"a": 1.5 / 4, "b": 1.5 / 4, "c": None, "d": 3 / 4}


def test_roll_z_warm_up_and_flat(spark):
    df = panel(spark, {"a": [1.0, 2.0, 3.0, 9.0], "b": [2.0] * 4})
    got = {(r.instrument, r.pos): r.z for r in normalize.roll_z(df, "x", "z", length=3, min_periods=3).collect()}
    assert got["a", 2] is None and got["a", 3] == pytest.approx(7.0) and got["b", 3] is None


def test_processors_are_causal_and_control_is_caught(spark):
    df = panel(spark, {k: [float((7 * i + n) % 11) for i in range(20)] for n, k in enumerate("abc")})
    for name, kwargs in (("roll_z", {"length": 5, "min_periods": 3}), ("roll_robust_z", {"length": 5, "min_periods": 2}), ("expanding_z", {"min_periods": 3}), ("cs_rank", {}), ("cs_z", {}), ("cs_robust_z", {})):
        f = normalize.build_processor({"class": name, "kwargs": kwargs})
        audit.assert_causal(df, "x", lambda d: f(d, "x", "z"), "z", position=10)
        assert not audit.prefix_invariance(df, "x", lambda d: f(d, "x", "z"), "z", keep=12).count()
    leaky = normalize.build_processor({"class": "global_z", "kwargs": {"allow_leaky": True}})
    with pytest.raises(audit.LeakageError):
        audit.assert_causal(df, "x", lambda d: leaky(d, "x", "z"), "z", position=10)
    with pytest.raises(ValueError):
        normalize.global_z(df, "x", "z")


def test_late_values_show_from_their_announcement(spark):
    days = grid.calendar(spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(30)], "datetime date"))
    events = spark.createDataFrame([("A", DAY, DAY + dt.timedelta(10), 42.0)], "instrument string, report_date date, announce_date date, roe double")
    spec = pit.LagSpec(values=("roe",))
    seen = pit.publish(events, days, spec)
    assert seen.agg(F.min("datetime")).first()[0] == DAY + dt.timedelta(10) and seen.count() == 20
    assert pit.publish(events, days, spec, max_periods=5).count() == 5
    assert not pit.verify(seen, events, spec).count()
    leaky = pit.publish(events, days, spec, mode="report_date", allow_leaky=True)
    assert pit.verify(leaky, events, spec).count() == 10
    with pytest.raises(ValueError):
        pit.publish(events, days, spec, mode="report_date")
    with pytest.raises(ValueError):
        pit.publish(events.withColumn("report_date", F.lit(dt.date(2021, 1, 1))), days, spec)


def test_membership_is_closed(spark):
    df = panel(spark, {"a": [1.0] * 6, "z": [1.0] * 6})
    iv = spark.createDataFrame([("a", DAY, DAY), ("a", DAY + dt.timedelta(2), DAY + dt.timedelta(4)), ("a", DAY + dt.timedelta(3), DAY + dt.timedelta(3)), ("q", DAY, DAY)], "instrument string, start date, end date")
    got = {(r.instrument, r.pos) for r in universe.membership_mask(df, iv).where("member").collect()}
    assert got == {("a", p) for p in (0, 2, 3, 4)}


def test_forward_return_keeps_rows(spark):
    df = panel(spark, {"a": [1.0, 2.0, 0.0, 4.0, 6.0]})
    spec = labels.LabelSpec(field="x")
    got = [r.y for r in labels.forward_return(df, spec, "y").orderBy("pos").collect()]
    assert got == [-1.0, None, 0.5, None, None]
    with pytest.raises(ValueError):
        labels.LabelSpec(horizon=0)


def test_perfect_and_reversed_scores(spark):
    rows = [(DAY + dt.timedelta(d), f"i{k}", float(k), s * float(k) ** 3) for d, s in ((0, 1), (1, -1)) for k in range(10)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, score double, label double")
    assert [round(r.ic, 12) for r in ic.rank_ic(df, min_obs=5).orderBy("datetime").collect()] == [1.0, -1.0]
    assert ic.rank_ic(df, min_obs=11).count() == 0
    with pytest.raises(ValueError):
        ic.rank_ic(df, min_obs=2)
    with pytest.raises(ValueError):
        grid.assert_unique(df.unionByName(df))


def test_newey_west_against_plain_sums(spark):
    import numpy as np

    x = np.random.default_rng(7).normal(0.1, 1, 60)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(100, None)], "datetime int, ic double")
    got = hac.newey_west(df, bandwidth=4).first()
    u = x - x.mean()
    lrv = sum((1 if not k else 2) * (1 - k / 5) * float(u[k:] @ u[: 60 - k]) / 60 for k in range(5))
    assert got.variance == pytest.approx(lrv, rel=1e-12)
    assert got.standard_error == pytest.approx(math.sqrt(lrv / 60 * 60 / 59), rel=1e-12)
    assert got.p_value == pytest.approx(math.erfc(abs(got.t_stat) / math.sqrt(2)), rel=1e-12)
    flat = hac.newey_west(spark.createDataFrame([(i, 0.05) for i in range(100)], "datetime int, ic double")).first()
    assert flat.standard_error is None and hac.newey_west(df.limit(2)).first().bandwidth == 0


def test_student_tail():
    assert tails.student_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-14)
    assert tails.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)


def test_date_permutation_is_a_bijection(spark):
    days = grid.calendar(spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(12)], "datetime date"))
    got = audit.date_permutation(days, 1, [1, 2])
    assert got.groupBy("b").agg(F.count_distinct("datetime").alias("d"), F.count_distinct("source").alias("s")).where("d = 12 and s = 12").count() == 2


def test_entry_without_training_data_operators():
    import __spark_entry__ as entry

    assert "rank_ic" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
