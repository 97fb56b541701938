import datetime as dt
import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import calibration, portfolio, risk, selection

DAY = dt.date(2020, 1, 1)


def rows_of(x, names=None):
    return [(DAY + dt.timedelta(t), t, k if names is None else names[k], float(v)) for (t, k), v in np.ndenumerate(x)]


def panel(spark, x):
    return spark.createDataFrame(rows_of(x), "datetime date, pos bigint, instrument int, x double")


def test_ledoit_wolf_is_that_of_matrices(spark):
    x = np.random.default_rng(1).normal(size=(12, 4)) @ np.diag([1, 2, 3, 1])
    got = {(r.a, r.b): (r.cov, r.delta) for r in risk.ledoit_wolf(panel(spark, x), "x").collect()}
    z = x - x.mean(0)
    s, n = z.T @ z / 12, 4
    d2 = ((s - np.trace(s) / n * np.eye(n)) ** 2).sum()
    b2 = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / 12**2
    delta = min(b2, d2) / d2
    want = (1 - delta) * s + delta * np.trace(s) / n * np.eye(n)
    assert all(got[a, b] == (pytest.approx(want[a, b]), pytest.approx(delta)) for a in range(n) for b in range(a, n))


def test_volatility_and_factor_covariance(spark):
    b, f = np.array([[1.0, 0.5], [0.2, 2.0], [1.0, 1.0]]), np.array([[2.0, 0.3], [0.3, 1.0]])
    flat = lambda m, names: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], names)
    cov = risk.factor_covariance(flat(b, "instrument int, factor int, exposure double"), flat(f, "f int, g int, cov double"), spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "instrument int, variance double"))
    want = b @ f @ b.T + np.diag([1.0, 2.0, 3.0])
    assert all(r["cov"] == pytest.approx(want[r.a, r.b]) for r in cov.collect()) and cov.count() == 6
    w = spark.createDataFrame([(DAY, 0, 0.5), (DAY, 1, -0.5), (DAY, 2, 0.0)], "datetime date, instrument int, weight double")
    v = np.array([0.5, -0.5, 0])
    scaled = {r.instrument: r.weight for r in risk.volatility_target(w, cov, 0.1).collect()}
    assert scaled == {i: pytest.approx(x * 0.1 / math.sqrt(v @ want @ v)) for i, x in enumerate(v)}


def test_cscv_is_that_of_all_halves(spark):
    x = np.random.default_rng(2).normal(size=(11, 3))
    trials = panel(spark, x).select("datetime", F.col("instrument").alias("trial"), F.col("x").alias("ret"))
    got = {r.split: r for r in selection.cscv(trials, 4).collect()}
    group = np.arange(11) * 4 // 11
    assert len(got) == 6
    for half in itertools.combinations(range(4), 2):
        inside = np.isin(group, half)
        r, oos = got[sum(1 << g for g in half)], x[~inside].mean(0)
        best = int(x[inside].mean(0).argmax())
        assert (r.best, r.oos, r["median"]) == (best, pytest.approx(oos[best]), pytest.approx(statistics.median(oos)))
    assert selection.pbo(trials.limit(0), 4).first().n_splits == 0


def test_monotonicity_of_an_order_and_of_none(spark):
    noise = np.random.default_rng(3).normal(size=(60, 4)) * 0.1
    run = lambda x: selection.monotonicity(panel(spark, x).select("datetime", (F.col("instrument") + 1).alias("bucket"), F.col("x").alias("ret")), 4, replicates=100, mean_block=5, seed=1).first()
    up, down = run(noise + np.arange(4)), run(noise - np.arange(4))
    assert up.p_mono == 0 and up.spearman == pytest.approx(1) and up.spread_lo < up.spread < up.spread_hi and up.n == 60
    assert down.p_mono == 1 and down.spearman == pytest.approx(-1)
    m = (noise + np.arange(4)).mean(0)
    assert up.gap == pytest.approx(np.diff(m).min())


def test_rank_losses(spark):
    x = [(DAY, 0, "a", 1.0, 3.0), (DAY, 0, "b", 2.0, 1.0), (DAY, 0, "c", 4.0, 9.0), (DAY, 0, "d", None, 1.0)]
    pairs = spark.createDataFrame(x, "datetime date, pos bigint, instrument string, score double, label double")
    hard = {r.instrument: r.soft_rank for r in calibration.soft_rank_loss(pairs, 1e-3).collect()}
    assert hard == {"a": pytest.approx(0.5), "b": pytest.approx(1.5), "c": pytest.approx(2.5)}
    loss = {r.instrument: r.loss for r in calibration.copula_loss(pairs).collect()}
    z = lambda v: (v - 7 / 3) / statistics.stdev([1, 2, 4])
    assert loss["a"] == pytest.approx(0, abs=1e-12) and loss["c"] == pytest.approx(-statistics.NormalDist().inv_cdf(0.75) * z(4))


@pytest.mark.parametrize("temperature", [0.5, 0.013, 40.0])
def test_soft_ranks_are_sums_over_all_scores(spark, temperature):
    """To rounding, with far outliers, ties and scores at the ends of intervals; and a date's scores never are one array."""
    x = np.r_[np.random.default_rng(6).normal(size=300) * 2, -90.0, 75.5, 1.0, 1.0, 0.5, 0.0]
    pairs = spark.createDataFrame([(DAY, k, float(v), float(k)) for k, v in enumerate(x)], "datetime date, instrument int, score double, label double")
    found = calibration.soft_rank_loss(pairs, temperature)
    far = np.clip((x[None, :] - x[:, None]) / temperature, -700, 700)
    want = (1 / (1 + np.exp(far))).sum(1)
    rows = {r.instrument: r for r in found.collect()}
    assert [rows[k].soft_rank for k in range(len(x))] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-11)
    rank, z = np.arange(len(x)) + 1.0, lambda v: (v - v.mean()) / v.std(ddof=1)
    assert [rows[k].loss for k in range(len(x))] == pytest.approx((-z(want) * z(rank) / len(x)).tolist(), abs=1e-10)
    assert "collect_list(struct(instrument" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_uniformity_with_ties_and_outside_values(spark):
    u = [0.5, 0.5, 0.5, 0.1, 1.0, 0.0, None, 1.5]
    df = spark.createDataFrame([(v,) for v in u], "u double")
    got = calibration.ks_uniform(df, "u").first()
    assert (got.n, got.ks) == (6, pytest.approx(max(5 / 6 - 0.5, 2 / 6 - 0.1)))
    assert {r.bin: r.n for r in calibration.pit_histogram(df, "u", 2).collect()} == {0: 2, 1: 4}
    assert calibration.ks_uniform(df.limit(0), "u").first().ks is None
    assert {r.level: r.covered for r in calibration.interval_coverage(df, "u", (0.5,)).collect()} == {0.5: pytest.approx(3 / 7)}


def test_net_return_identity_and_capacity(spark):
    x = [(DAY, 0, "a", 1.0, 0.1), (DAY + dt.timedelta(1), 1, "a", 0.5, 0.2), (DAY, 0, "b", 0.0, 0.3), (DAY + dt.timedelta(1), 1, "b", 0.5, None)]  # no dispersion of gross returns
    grid = spark.createDataFrame(x, "datetime date, pos bigint, instrument string, weight double, label double")
    got = {r.datetime: r for r in portfolio.net_returns(grid, buy=0.001, sell=0.002).collect()}
    last = got[DAY + dt.timedelta(1)]
    assert last.net == pytest.approx(0.1 - 0.5 * 0.001 - 0.5 * 0.002) and got[DAY].net == pytest.approx(0.1 - 0.001)
    curve = portfolio.capacity_curve(grid.withColumns({"label": F.col("label") * (F.col("pos") + 1), "sigma": F.lit(0.02), "adv": F.lit(100.0)}), [1e2, 1e9], eta=1.0).orderBy("amount").collect()
    assert [r.amount for r in curve] == [0, 1e2, 1e9] and curve[-1].ir < curve[0].ir


def test_block_length(spark):
    from panelgrid.operators import inference

    r = np.random.default_rng(4)
    e = r.normal(size=400)
    x = [float(e[0])]
    for v in e[1:]:
        x.append(0.7 * x[-1] + float(v))
    frame = lambda v: spark.createDataFrame([(i, float(y)) for i, y in enumerate(v)], "datetime int, ic double")
    white, kept = inference.block_length(frame(e), col="ic"), inference.block_length(frame(x), col="ic")
    assert 1 <= white < kept < 60 and inference.block_length(frame([1.0] * 9), col="ic") == 1.0 and inference.block_length(frame([]), col="ic") == 1.0


def test_studentized_monotonicity(spark):
    from panelgrid.operators import selection

    r = np.random.default_rng(6)
    rise = [(d, k, float(0.3 * k + r.normal())) for d in range(200) for k in range(1, 5)]
    flat = [(d, k, float(r.normal())) for d in range(200) for k in range(1, 5)]
    schema = "datetime int, bucket int, ret double"
    test = lambda rows: selection.monotonicity_studentized(spark.createDataFrame(rows, schema), 4, replicates=300, block=4, seed=1).first()
    up, no = test(rise), test(flat)
    assert up.n == 200 and up.t_gap > 1 and up.p_mono < 0.05 < no.p_mono
    assert all(lo < hi for lo, hi in zip(up.lo, up.hi, strict=True)) and test([]).t_gap is None


def test_fitted_robust(spark):
    from panelgrid.operators import normalize

    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    got = sorted(r.x for r in normalize.apply_robust(df, normalize.fit_robust(df, ["x"]), ["x"], fill=0.0).collect())
    assert got[-1] == 3.0 and got[0] == pytest.approx(-2 / 1.4826022) and got.count(0.0) == 2
    assert all(r.x is None for r in normalize.apply_robust(df, normalize.fit_robust(df.limit(0), ["x"]), ["x"]).collect())
