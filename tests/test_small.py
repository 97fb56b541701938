"""Operators that had neither a query nor a test: alignment, ingress, sorting at sinks, tests of many hypotheses, residuals, losses, masks."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.functions import tails
from panelgrid.operators import calibration, grid, ic, inference, normalize, pit, portfolio, tensor
from panelgrid.sources import synthetic

DAY = dt.date(2022, 5, 2)


def long(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ingress_and_required_columns(spark):
    df = long(spark, [("1.5", 2.0), ("x", float("nan")), (None, float("inf"))], "a string, b double")
    assert [tuple(r) for r in grid.ingress(df, ["a", "b"]).collect()] == [(1.5, 2.0), (None, None), (None, None)]
    with pytest.raises(ValueError, match="missing columns: c, d"):
        grid.require_columns(df, ["d", "a", "c"])


def test_repeated_keys_are_named(spark):
    rows = [(DAY, k) for k in "bbaaccdde"]
    df = long(spark, rows, "datetime date, instrument string")
    with pytest.raises(ValueError, match=r"2022-05-02, a; 2022-05-02, b; 2022-05-02, c$"):
        grid.assert_unique(df)
    assert grid.assert_unique(df.distinct()).count() == 5


def test_alignment_keeps_pairs_that_both_have(spark):
    schema = "datetime date, instrument string, {} double"
    scores = long(spark, [(DAY, "a", 1.0), (DAY, "b", None), (DAY, "c", 2.0)], schema.format("score"))
    label = long(spark, [(DAY, "a", 3.0), (DAY, "b", 1.0), (DAY, "d", 2.0)], schema.format("label"))
    assert [tuple(r) for r in ic.align(scores, label).collect()] == [(DAY, "a", 1.0, 3.0)]
    assert ic.dropped_dates(ic.align(scores, label), min_obs=2).first()[0] == 1


def test_positional_ranks(spark):
    rows = [(DAY, i, x, y) for i, (x, y) in enumerate([(1.0, 4.0), (1.0, 3.0), (2.0, 2.0), (3.0, 2.0), (9.0, None)])]
    got = ic.per_date_correlation(long(spark, rows, "datetime date, instrument int, x double, y double"), "x", "y", ranked=True).first()
    # ties take the order of instruments: ranks 1 2 3 4 and 4 3 1 2
    assert (got.n, got.ic) == (4, pytest.approx(np.corrcoef([1, 2, 3, 4], [4, 3, 1, 2])[0, 1]))


def test_correlation_of_flat_and_thin_dates(spark):
    rows = [(DAY, i, 0.1, float(i)) for i in range(4)] + [(DAY + dt.timedelta(1), i, float(i), float(-i)) for i in range(3)] + [(DAY + dt.timedelta(2), i, float(i), 1.0 + i) for i in range(2)]
    pairs = long(spark, rows, "datetime date, instrument int, score double, label double")
    for f in (ic.rank_ic, ic.pearson_ic):
        assert [(r.datetime, r.n, r.ic) for r in f(pairs, min_obs=3).collect()] == [(DAY + dt.timedelta(1), 3, pytest.approx(-1))]
        with pytest.raises(ValueError):
            f(pairs, min_obs=2)


def test_many_tests_with_ties_and_missing_ones(spark):
    r = np.random.default_rng(1)
    p = [float(x) for x in np.round(r.random(300), 2)] + [0.0, 0.0, 1.0, 1.0, 1.0, 0.25, 0.5]
    df = long(spark, [(i, x) for i, x in enumerate(p)] + [(-1, None), (-2, None)], "name int, p double")
    m, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    bh, hm, least, most = {}, {}, 1.0, 0.0
    for k in range(m, 0, -1):
        least = min(least, p[order[k - 1]] * m / k)
        bh[order[k - 1]] = least
    for k in range(1, m + 1):
        most = max(most, p[order[k - 1]] * (m - k + 1))
        hm[order[k - 1]] = min(1.0, most)
    for f, name, want in ((inference.benjamini_hochberg, "p_bh", bh), (inference.holm, "p_holm", hm)):
        got = {x.name: x[name] for x in f(df).collect()}
        assert got.pop(-1) is None and got.pop(-2) is None
        assert got == {i: pytest.approx(v, rel=1e-12) for i, v in want.items()}
        assert f(df.where("p is null")).where(f"{name} is null").count() == 2 and f(df.limit(0)).count() == 0


def test_residuals_of_dependent_and_constant_exposures(spark):
    r = np.random.default_rng(2)
    rows = []
    for t in range(3):
        for i in range(12):
            x = float(r.normal())
            rows.append((DAY + dt.timedelta(t), i, None if i == 5 else float(2 * x + r.normal() + 1e5), x, 3 * x + 1, 1.0 if t < 2 else float(i % 2)))
    df = long(spark, rows, "datetime date, instrument int, y double, a double, b double, c double")
    got = {(g.datetime, g.instrument): g.residual for g in inference.residualize(df, "y", ["a", "b", "c"]).collect()}
    for t in range(3):
        own = [x for x in rows if x[0] == DAY + dt.timedelta(t) and x[2] is not None]
        design = np.array([[1, *x[3:]] for x in own])
        want = np.array([x[2] for x in own]) - design @ np.linalg.lstsq(design, np.array([x[2] for x in own]), rcond=None)[0]
        assert [got[x[:2]] for x in own] == [pytest.approx(v, abs=1e-5) for v in want]
        assert got[DAY + dt.timedelta(t), 5] is None
    assert len(got) == 36 and inference.residualize(df.limit(0), "y", ["a"]).count() == 0


def test_losses_of_distributions(spark):
    df = long(spark, [(1.0, 0.5, 2.0, 5.0, True, 1.0), (3.0, 0.0, 1.0, 3.0, True, 3.0), (9.0, 0.0, 1.0, 3.0, False, 1.0), (None, 0.0, 1.0, 3.0, True, 1.0)], "y double, m double, s double, nu double, ok boolean, w double")
    normal = [r.nll for r in inference.gaussian_nll(df, "y", "m", "s").collect()]
    assert normal[:2] == [pytest.approx(-math.log(statistics.NormalDist(m, s).pdf(y))) for y, m, s in ((1.0, 0.5, 2.0), (3.0, 0.0, 1.0))]
    density = lambda z, v, s: math.gamma((v + 1) / 2) / (math.gamma(v / 2) * math.sqrt(v * math.pi) * s) * (1 + z * z / v) ** (-(v + 1) / 2)
    student = [r.nll for r in inference.student_nll(df, "y", "m", "s", "nu").collect()]
    assert student[:2] == [pytest.approx(-math.log(density(0.25, 5, 2))), pytest.approx(-math.log(density(3.0, 3, 1)))]
    masked = inference.masked_mean_nll(inference.gaussian_nll(df, "y", "m", "s"), "nll", "ok", "w").first()
    assert (masked.n, masked.objective) == (2, pytest.approx((normal[0] + 3 * normal[1]) / 4))
    assert inference.masked_mean_nll(inference.gaussian_nll(df.where("not ok and ok"), "y", "m", "s"), "nll", "ok").first().objective is None


def test_copula_scores_of_ties(spark):
    rows = [(DAY, k, float(s), float(y)) for k, s, y in (("a", 1, 5), ("b", 2, 5), ("c", 4, 7), ("d", 9, 1))]
    got = {r.instrument: r.loss for r in calibration.copula_loss(long(spark, rows, "datetime date, instrument string, score double, label double")).collect()}
    z = lambda v: (v - 4) / statistics.stdev([1, 2, 4, 9])
    q = statistics.NormalDist().inv_cdf
    assert got == {"a": pytest.approx(-q(2.5 / 5) * z(1), abs=1e-12), "b": pytest.approx(-q(2.5 / 5) * z(2), abs=1e-12), "c": pytest.approx(-q(4 / 5) * z(4)), "d": pytest.approx(-q(1 / 5) * z(9))}


def test_loss_comparison(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(0.3, 1, 60), r.normal(0, 1, 60)
    df = long(spark, [(DAY + dt.timedelta(i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "datetime date, a double, b double")
    got = inference.diebold_mariano(df, "a", "b", horizon=4).first()
    d = a**2 - b**2
    u, width = d - d.mean(), 6  # floor(1.5 * 4) exceeds the automatic 3
    v = u @ u / 60 + 2 * sum((1 - k / (width + 1)) * (u[k:] @ u[:-k]) / 60 for k in range(1, width + 1))
    assert (got.bandwidth, got.n_obs) == (6, 60) and got.t_stat == pytest.approx(d.mean() / (math.sqrt(v / 60) * math.sqrt(60 / 58)))
    assert inference.diebold_mariano(df.limit(2), "a", "b", horizon=4).first().t_stat is None


def test_performance_record(spark):
    x = [0.1, -0.2, 0.05, None, 0.3]
    got = portfolio.performance(long(spark, [(DAY + dt.timedelta(i), v) for i, v in enumerate(x)], "datetime date, ret double"), periods_per_year=12).first()
    known = [v for v in x if v is not None]
    assert (got.n, got.max_drawdown) == (4, pytest.approx(-0.2)) and got.mean_annual == pytest.approx(12 * statistics.fmean(known))
    assert got.sharpe == pytest.approx(statistics.fmean(known) / statistics.stdev(known) * math.sqrt(12)) and got.calmar == pytest.approx(got.mean_annual / 0.2)


def test_components_and_what_bundles_are_filled_with(spark):
    rows = [(DAY + dt.timedelta(t), t, "a", None if t == 1 else float(t), float(t)) for t in range(3)]
    bundle = tensor.sequence_bundle(long(spark, rows, "datetime date, pos bigint, instrument string, x double, y double"), ["x"], "y", lookback=2, fill=-7.0, min_valid_steps=2)
    assert [r.enough_valid_steps for r in tensor.select_component(bundle, "enough_valid_steps").orderBy("datetime").collect()] == [False, False, False]
    assert tensor.describe(bundle, fill=-7.0).first().fill_value == -7.0
    with pytest.raises(KeyError, match="known: label_available"):
        tensor.select_component(bundle, "other")


def test_figures_of_dates(spark):
    rows = [(DAY + dt.timedelta(t), i, None if i == 3 else float(i * (t + 1))) for t in range(2) for i in range(4)]
    df = long(spark, rows, "datetime date, instrument int, x double")
    z = {(r.datetime, r.instrument): r.z for r in normalize.cs_z(df, "x", "z").collect()}
    assert z == {(d, i): None if x is None else pytest.approx(i - 1) for d, i, x in rows}
    flat = normalize.cs_standardize(df.withColumn("x", F.lit(0.1)), "x", "z")
    assert {r.z for r in flat.collect()} == {0.0}


def test_positions_between_trading_days(spark):
    days = grid.calendar(long(spark, [(DAY + dt.timedelta(i),) for i in (0, 1, 4, 9)], "datetime date"))
    asked = long(spark, [(DAY + dt.timedelta(i),) for i in (-3, 0, 1, 2, 4, 5, 9, 10)] + [(None,)], "d date")
    assert [r.p for r in pit.positions(asked, days, "d", "p").orderBy(F.asc_nulls_last("d")).collect()] == [0, 0, 1, 2, 2, 3, 3, 4, 4]


def test_ground_truth_of_a_panel(spark):
    spec = synthetic.PanelSpec(instruments=40, days=120, correlation=0.3, noise_rho=0.0, noise_df=8.0, seed=3)
    got = synthetic.ground_truth(spark, spec, draws=6).first()
    assert (got.n_dates, got.n_observations, got.draws, got.shock_kurtosis) == (120, 4_800, 6, 1.5)
    for value in (got.realized_mean_rank_ic, got.expected_rank_ic):
        assert value == pytest.approx(spec.copula_rank_ic, abs=0.05)
    assert got.realized_mean_pearson_ic == pytest.approx(0.3, abs=0.05) and 0 < got.expected_rank_ic_error < 0.02 and abs(got.ic_acf1) < 0.3
    draws = synthetic.ic_of_draws(spark, spec, 2)
    assert {r.draw for r in draws.select("draw").distinct().collect()} == {0, 1, 2}
    assert synthetic.ground_truth(spark, spec, draws=0).first().expected_rank_ic is None


def test_draws_of_noise_are_made_beside_their_score(spark):
    """A panel is never joined with its draws: the only join is that of a date's figures."""
    spec = synthetic.PanelSpec(instruments=5, days=7, noise_rho=0.3, seed=4)
    ics = synthetic.ic_of_draws(spark, spec, 2)
    assert ics._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    score = {(r.instrument, r.pos): r.score for r in synthetic.generate(spark, spec).collect()}
    shocks = np.stack([np.random.default_rng([4, i, 2]).standard_t(spec.noise_df, synthetic.BURN_IN + 7) for i in range(5)]) * math.sqrt(0.6)
    shocks[:, 1:] *= math.sqrt(1 - 0.3**2)
    noise = shocks.copy()
    for t in range(1, noise.shape[1]):
        noise[:, t] += 0.3 * noise[:, t - 1]
    place = lambda v: np.argsort(np.argsort(v))
    want = [np.corrcoef(place([score[f"S{i:04d}", t] for i in range(5)]), place([spec.beta * score[f"S{i:04d}", t] + noise[i, synthetic.BURN_IN + t] for i in range(5)]))[0, 1] for t in range(7)]
    got = [r.ic for r in ics.where("draw = 2").orderBy("datetime").collect()]
    assert got == pytest.approx(want)


def test_tails(spark):
    df = long(spark, [(0.0, 5.0), (2.0, 5.0), (None, 5.0), (float("nan"), 5.0)], "t double, df double")
    got = [r[0] for r in df.select(tails.p_student("t", "df")).collect()]
    assert got[:2] == [1.0, pytest.approx(0.10193947, abs=1e-7)] and got[2:] == [None, None]
    assert [r[0] for r in df.select(tails.p_normal("t")).collect()][1] == pytest.approx(0.04550026, abs=1e-7)


def test_publication_and_its_verification_are_spread_over_tasks(spark, monkeypatch):
    days = grid.calendar(long(spark, [(DAY + dt.timedelta(i),) for i in range(30)], "datetime date"))
    rows = [(k, DAY + dt.timedelta(i), DAY + dt.timedelta(i + 3 + k % 4), float(k + i)) for k in range(200) for i in (0, 9, 18)]
    events = long(spark, rows, "instrument int, report_date date, announce_date date, v double")
    spec = pit.LagSpec(values=("v",))
    early = pit.publish(events, days, spec, mode="report_date", allow_leaky=True)
    wrong = lambda **kwargs: pit.verify(pit.publish(events, days, spec, mode="report_date", allow_leaky=True, **kwargs), events, spec, **kwargs)
    few = {tuple(r) for r in wrong().collect()}
    assert len(few) == sum(3 * (3 + k % 4) for k in range(200))  # the days by which each value is early
    monkeypatch.setattr(grid, "TASK_ROWS", 250, raising=False)

    def check(found):
        assert {tuple(r) for r in found.collect()} == few
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 15 and max(r["count"] for r in tasks) < 750

    check(pit.verify(early, events, spec))  # of a publication made before
    check(wrong(rows=len(rows) + early.count()))  # of one beside it
    assert len(pit.publish(events, days, spec, rows=5_000).groupBy(F.spark_partition_id()).count().collect()) > 15
