import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import inference, labels, risk, selection
from panelgrid.sources import config, store, synthetic


@pytest.fixture(scope="module")
def panel(spark):
    return synthetic.generate(spark, synthetic.PanelSpec(instruments=40, days=60, signal_kind="nonlinear", correlation=0.4)).toPandas()


def test_generated_panel_has_its_shape_and_relation(panel):
    assert len(panel) == 2400 and panel.datetime.nunique() == 60 and str(panel.datetime.min()) == "2000-01-03"
    assert all(d.weekday() < 5 for d in panel.datetime.unique()) and sorted(panel.instrument.unique())[-1] == "S0039"
    by = panel.groupby("datetime").score
    assert by.mean().abs().max() < 1e-9 and abs(by.std(ddof=0) - 1).max() < 1e-9
    assert panel.groupby("datetime")[["score", "label"]].corr().iloc[0::2, 1].mean() == pytest.approx(0.4, abs=0.08)
    beta = 0.4 / math.sqrt(1 - 0.16)
    assert np.allclose(panel.label, beta * panel.score + panel.noise)


def test_generated_panel_does_not_depend_on_tasks(spark, panel):
    spec = synthetic.PanelSpec(instruments=40, days=60, signal_kind="nonlinear", correlation=0.4)
    again = synthetic.generate(spark, spec).repartition(3).toPandas()
    key = ["pos", "instrument"]
    assert np.array_equal(again.sort_values(key).noise.to_numpy(), panel.sort_values(key).noise.to_numpy())


@pytest.mark.parametrize("wrong", [{"instruments": 2}, {"features": 6}, {"features": 2, "signal_kind": "nonlinear"}, {"noise_df": 2.0}, {"correlation": 1.0}, {"feature_kind": "x"}])
def test_wrong_specs(wrong):
    with pytest.raises(ValueError, match=list(wrong)[0]):
        synthetic.PanelSpec(**wrong)


def test_paths(tmp_path):
    paths = config.Paths(tmp_path, {"DATA_DIR": "/env"}, ARTIFACT_ROOT="/given")
    assert str(paths("DATA_DIR", "data")) == "/env" and str(paths("ARTIFACT_ROOT", "artifacts")) == "/given" and paths("PROVIDER_URI", "store") == tmp_path / "store"
    assert set(paths.overrides) == {"DATA_DIR", "ARTIFACT_ROOT"}
    assert config.Paths(tmp_path, {}).expand("${ARTIFACT_ROOT:-artifacts}/x ${DATA_DIR:-/d}") == f"{tmp_path.as_posix()}/artifacts/x /d"
    for environ, text in (({"DATA_DIR": " "}, "${DATA_DIR}"), ({"DATA_DIR": "a/b"}, "${DATA_DIR}"), ({}, "${HOME}"), ({}, "${DATA_DIR:-rel}"), ({"DATA_DIR": __file__}, "${DATA_DIR}")):
        with pytest.raises(config.ConfigError):
            config.Paths(tmp_path, environ).expand(text)


STUDY = """
study: {name: a, seed: 7}
qlib_init: {provider_uri: '${ARTIFACT_ROOT:-artifacts}'}
data_handler: {kwargs: {start_time: 2020-01-01, end_time: 2020-04-01, fit_start_time: 2020-01-01, fit_end_time: 2020-02-01, instruments: all}}
segments: {train: ['2020-01-01', '2020-02-01'], valid: ['2020-02-02', '2020-03-01'], test: ['2020-03-02', '2020-04-01'], purge_radius: 1}
model: {kwargs: {lr: 0.01}}
backtest: {start_time: '2020-03-02', end_time: '2020-04-01', exchange_kwargs: {open_cost: 0.001}}
"""


def test_study(tmp_path):
    file = tmp_path / "study.yaml"
    file.write_text(STUDY)
    one, two = (config.load_study(file, config.Paths(tmp_path, e)) for e in ({}, {"ARTIFACT_ROOT": "/o"}))
    assert one.segments.purge_radius == 1 and one.hash != two.hash and two.overrides == {"ARTIFACT_ROOT": "/o"}
    assert (one.name, one.seed, one.values["model.kwargs.lr"], one.values["model.kwargs.batch_size"], one.values["backtest.exchange_kwargs.close_cost"]) == ("a", 7, 0.01, 1024, 0.0025)
    assert two.dump(tmp_path / "out").read_text().count("/o") == 2
    with pytest.raises(config.ConfigError):
        config.Segments(("2020-01-01", "2020-02-02"), ("2020-02-02", "2020-03-01"), ("2020-03-02", "2020-04-01"))


@pytest.mark.parametrize(
    ("old", "new", "says"),
    [
        ("model: {kwargs: {lr: 0.01}}", "", "missing blocks: model"),
        ("study:", "other:", "unknown blocks: other"),
        ("seed: 7", "seed: true", "study.seed has to be a whole number"),
        ("seed: 7", "seed: '7'", "study.seed has to be a whole number"),
        ("seed: 7", "seed: -1", "study.seed can't be negative"),
        ("name: a", "name: ''", "study.name can't be empty"),
        ("lr: 0.01", "lr: 0", "lr has to be positive"),
        ("lr: 0.01", "rate: 1", "model.kwargs.rate is unknown"),
        ("open_cost: 0.001", "open_cost: 0", "open_cost is zero"),
        ("open_cost: 0.001", "min_cost: 0.0", "min_cost is zero"),
        ("open_cost: 0.001", "open_cost: -1", "open_cost can't be negative"),
        ("open_cost: 0.001", "trade_unit: 1", "has to be 100 shares"),
        ("{open_cost: 0.001}", "[1]", "exchange_kwargs has to be a mapping"),
        (", instruments: all", "", "data_handler.kwargs.instruments is missing"),
        ("fit_end_time: 2020-02-01", "fit_end_time: 2020-02-03", "fitted beyond the train segment"),
        ("end_time: 2020-04-01,", "end_time: 2020-03-20,", "ends before a segment does"),
        ("start_time: '2020-03-02'", "start_time: '2020-03-01'", "leaves the test segment"),
        ("start_time: '2020-03-02'", "start_time: 'soon'", "backtest.start_time has to be a date"),
        ("valid: ['2020-02-02', '2020-03-01']", "valid: ['2020-02-02']", "segments.valid has to be a pair of dates"),
        ("valid: ['2020-02-02', '2020-03-01']", "valid: ['2020-01-02', '2020-03-01']", "in order, without overlap"),
        ("provider_uri:", "kernels: 4, provider_uri:", "needs allow_multiprocessing"),
    ],
)
def test_study_that_cannot_be_used(tmp_path, old, new, says):
    file = tmp_path / "study.yaml"
    assert old in STUDY
    file.write_text(STUDY.replace(old, new, 1))
    with pytest.raises(config.ConfigError, match=says):
        config.load_study(file, config.Paths(tmp_path, {}))
    if "zero" in says:
        assert config.load_study(file, config.Paths(tmp_path, {}), allow_zero_cost=True).seed == 7


def test_sources_of_a_store(spark, tmp_path):
    """Membership files, field scans and snapshots."""
    (tmp_path / "all.txt").write_text("B 2020-01-02 2020-02-01\nA 2020-01-01  2020-01-31\nbroken line\nA 2020-03-01 2020-03-31\nC soon later\n")
    assert [tuple(map(str, r)) for r in store.load_instruments(spark, str(tmp_path / "all.txt")).collect()] == [("A", "2020-01-01", "2020-01-31"), ("A", "2020-03-01", "2020-03-31"), ("B", "2020-01-02", "2020-02-01")]
    (tmp_path / "none.txt").write_text("nothing\n")
    with pytest.raises(ValueError):
        store.load_instruments(spark, str(tmp_path / "none.txt"))
    rows = [(dt.date(2020, 1, d), k, float(d), None if k == "b" else 1) for d in (1, 2, 3) for k in "ab"]
    panel = spark.createDataFrame(rows, "datetime date, instrument string, x double, y int")
    assert sorted(map(tuple, store.field_scan(panel, ["a"], ["x"], "2020-01-02", "2020-01-09").collect())) == [(dt.date(2020, 1, d), "a", float(d)) for d in (2, 3)]
    content = lambda df, to: {r.datetime: (r.n, r.content) for r in store.write_snapshots(df, f"{tmp_path}/{to}").collect()}
    first = content(panel.repartition(3), "one")
    assert content(panel.select("y", "instrument", "x", "datetime").orderBy(F.desc("instrument")).coalesce(1), "two") == first and all(n == 2 for n, _ in first.values())
    assert len({c for _, c in first.values()}) == 3 and spark.read.parquet(f"{tmp_path}/one").count() == 6
    changed = content(panel.unionByName(panel.where("x = 2 AND y IS NULL")), "three")
    assert [d for d in first if changed[d] != first[d]] == [dt.date(2020, 1, 2)] and changed[dt.date(2020, 1, 2)][0] == 3


def test_kinds_root(tmp_path):
    from panelgrid.sources.artifacts import Artifacts

    assert Artifacts(tmp_path).folder("models") == tmp_path / "models" and (tmp_path / "models").is_dir()


def test_segment_roles(spark):
    days = spark.sql("SELECT date_add(DATE '2020-01-30', CAST(id AS INT)) AS datetime, id AS pos FROM range(6)")
    made = labels.segment_roles(days, config.Segments(("2020-01-30", "2020-01-31"), ("2020-02-01", "2020-02-02"), ("2020-02-03", "2020-02-03"), purge_radius=1))
    assert [r.role for r in made.orderBy("pos").collect()] == ["train", "purged", "valid", "purged", "test", None]


@pytest.mark.parametrize("most", [10, 1])
def test_psd_repair(spark, most):
    bad = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 2, 1.0)], "a int, b int, cov double")
    fixed, epsilon = risk.psd_repair(bad, most=most)
    m = {(r.a, r.b): r.cov for r in fixed.collect()}
    assert np.linalg.eigvalsh([[m[1, 1], m[1, 2]], [m[1, 2], m[2, 2]]])[0] == pytest.approx(1e-8, abs=1e-12) and epsilon == pytest.approx(1 + 1e-8)
    good = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 2, 2.0)], bad.schema)
    assert risk.psd_repair(good, most=most)[1] == 0.0


def test_deflated_sharpe(spark):
    from statistics import NormalDist

    r = np.random.default_rng(5)
    x = r.normal(0.1, 1, (3, 80))
    x[2] = x[1]
    rows = [(t, k, float(x[k][t])) for k in range(3) for t in range(80)]
    got = selection.deflated_sharpe(spark.createDataFrame(rows, "datetime int, trial int, ret double")).first()
    sr = x.mean(1) / x.std(1, ddof=1)
    best = max(range(3), key=lambda k: (sr[k], k))
    d, inv = x[best] - x[best].mean(), NormalDist().inv_cdf
    skew, kurt = (d**3).mean() / d.var() ** 1.5, (d**4).mean() / d.var() ** 2
    star = sr.std(ddof=1) * ((1 - 0.5772156649015329) * inv(0.5) + 0.5772156649015329 * inv(1 - 1 / (2 * math.e)))
    want = NormalDist().cdf((sr[best] - star) * math.sqrt(79) / math.sqrt(1 - skew * sr[best] + (kurt - 1) / 4 * sr[best] ** 2))
    assert (got.trial, got.k_eff) == (best, 2) and got.dsr == pytest.approx(want, abs=1e-9)


def test_residuals_are_orthogonal(spark, panel):
    df = spark.createDataFrame(panel[["datetime", "instrument", "label", "f0", "f1"]])
    got = inference.residualize(df, "label", ["f0", "f1"]).toPandas()
    assert got.groupby("datetime").apply(lambda g: abs(float((g.residual * g.f0).sum())) + abs(float(g.residual.sum())), include_groups=False).max() < 1e-8
