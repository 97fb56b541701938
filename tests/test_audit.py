"""The leakage audit and its parts against NumPy, with a control that has to fire."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelgrid.operators import audit, hac, pit
from panelgrid.sources.artifacts import KINDS, Artifacts, content_hash
from panelgrid.streaming import daily

START = dt.date(2018, 1, 1)
DAYS, ISSUERS = 48, 12


def orbit(x, n):
    """A chaotic sequence between 0 and 1: as good as noise, and the same everywhere."""
    out = []
    for _ in range(n):
        x = 3.99 * x * (1 - x)
        out.append(x)
    return np.array(out)


@pytest.fixture(scope="module")
def market(spark):
    """A value signal with a payoff, and issuers with two share classes that trade a hair apart, both in signal and payoff."""
    size = DAYS * ISSUERS
    signal, other, luck = (orbit(x, size).reshape(DAYS, ISSUERS) for x in (0.31, 0.57, 0.83))
    payoff = 0.8 * signal + luck
    cells = [(START + dt.timedelta(t), t, f"{k}{c}", signal[t, k] + j, other[t, k], payoff[t, k] + j) for t in range(DAYS) for k in range(ISSUERS) for c, j in (("A", 0.0), ("B", 1e-6))]
    both = pd.DataFrame(cells, columns=["datetime", "pos", "instrument", "signal", "other", "label"])
    classes = spark.createDataFrame(both)
    single = both[both.instrument.str.endswith("A")]
    return single, spark.createDataFrame(single), classes, classes.select("datetime", "pos").distinct()


def neighbour():
    """Predicts the label of the training row that is nearest in the first feature. Made inside, so that workers get it by value."""

    def nearest(train_x, train_y, test_x):
        order = np.argsort(train_x[:, 0])
        known, labels = train_x[order, 0], train_y[order]
        right = np.clip(np.searchsorted(known, test_x[:, 0]), 1, len(known) - 1)
        left_is_nearer = test_x[:, 0] - known[right - 1] < known[right] - test_x[:, 0]
        return labels[right - left_is_nearer]

    return nearest


def test_ridge_is_least_squares_with_penalty_rows(market):
    single, rows, _, _ = market
    penalty = 3.0
    got = {(r.fold, r.datetime, r.instrument): (r.score, r.label) for r in audit.ridge_oos(rows, ["signal", "other"], audit.expanding_folds(DAYS, 4, 3), alpha=penalty).collect()}
    design = lambda part: np.column_stack([np.ones(len(part)), part.signal, part.other])
    seen = 0
    for fold, end, low, high in audit.expanding_folds(DAYS, 4, 3):
        train, test = single[single.pos < end], single[single.pos.between(low, high - 1)]
        rows_of_penalty = np.sqrt(penalty) * np.array([[0, 1, 0], [0, 0, 1]])
        beta = np.linalg.lstsq(np.vstack([design(train), rows_of_penalty]), np.r_[train.label, 0, 0], rcond=None)[0]
        for row, score in zip(test.itertuples(), design(test) @ beta, strict=True):
            assert got[fold, row.datetime, row.instrument] == (pytest.approx(score, rel=1e-9), row.label)
            seen += 1
    assert seen == len(got)


def test_users_model_gets_each_folds_rows(market):
    single, rows, _, _ = market

    def side_means(train_x, train_y, test_x):
        high = train_x[:, 0] > 0.5
        return np.where(test_x[:, 0] > 0.5, train_y[high].mean(), train_y[~high].mean())

    got = audit.model_oos(rows, ["signal"], audit.expanding_folds(DAYS, 2, 1), side_means).toPandas()
    for fold, end, low, high in audit.expanding_folds(DAYS, 2, 1):
        train = single[single.pos < end]
        means = train.groupby(train.signal > 0.5).label.mean()
        part = got[got.fold == fold].merge(single, on=["datetime", "instrument"])
        assert part.pos.min() == low and part.pos.max() == high - 1
        assert np.allclose(part.score, (part.signal > 0.5).map(means))


def test_purged_folds_are_clean(market):
    _, rows, classes, days = market
    run = lambda df, **kwargs: audit.leakage_audit(df, ["signal", "other"], days, radius=3, n_permutations=24, **kwargs)
    first = run(rows, seed=7)
    assert (first["verdict"], first["n_permutations"]) == ("clean", 24) and first["observed_ic"] > 0.3
    assert first["q05"] <= first["shuffle_mean_ic"] <= first["q95"]
    again, other = run(rows, seed=7), run(rows, seed=8)
    assert again == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in first.items()}
    assert other["shuffle_mean_ic"] != first["shuffle_mean_ic"] and other["observed_ic"] == pytest.approx(first["observed_ic"])


def test_ics_by_tiles_of_dates_are_those_of_all_rows(market):
    """Without forming the replicates' rows, with missing labels and signals."""
    from pyspark.sql import functions as F

    _, rows, _, days = market
    holes = F.pmod(F.xxhash64("instrument", "pos"), F.lit(9))
    gaps = rows.withColumns({"label": F.when(holes != 1, F.col("label")), "signal": F.when(holes != 2, F.col("signal"))})
    mapping = audit.date_permutation(days, 3, range(1, 5))
    folds = audit.expanding_folds(DAYS, 3, 2)
    got = audit._mean_ics(gaps, ["signal", "other"], mapping, days, folds, alpha=1.0, min_obs=5)
    want = audit._mean_ics_of_rows(gaps, ["signal", "other"], mapping, folds, None, rows_of_mapping=4 * DAYS, alpha=1.0, min_obs=5, seed=0)
    assert got == {b: pytest.approx(v, abs=1e-12) for b, v in want.items()} and len(got) == 4


def test_a_share_class_in_another_fold_gives_its_twin_away(market):
    _, _, classes, days = market
    run = lambda **kwargs: audit.leakage_audit(classes, ["signal"], days, radius=3, n_permutations=12, seed=5, **kwargs)
    caught = run(model=neighbour(), fold_scheme="overlapping")
    assert caught["verdict"] == "leakage_detected" and caught["shuffle_mean_ic"] > 0.1
    assert run(model=neighbour())["verdict"] == "clean"  # purged folds keep the twins of a date together
    assert run(fold_scheme="overlapping")["verdict"] == "clean"  # a line can't remember rows: such a model is blind to the fault
    with pytest.raises(audit.LeakageError):
        audit.assert_no_leakage(classes, ["signal"], days, radius=3, n_permutations=12, seed=5, model=neighbour(), fold_scheme="overlapping")


def test_audits_that_cannot_be_made(market):
    _, rows, _, days = market
    with pytest.raises(ValueError):
        audit.leakage_audit(rows, ["signal"], days, radius=3, fold_scheme="other")
    with pytest.raises(RuntimeError):  # no date has enough pairs for a statistic
        audit.leakage_audit(rows, ["signal"], days, radius=3, n_permutations=3, min_obs=2 * ISSUERS)
    with pytest.raises(RuntimeError):
        audit.leakage_audit(rows, ["signal"], days, radius=3, n_permutations=1)


def test_hac_record_and_errors(spark):
    df = spark.createDataFrame([(START + dt.timedelta(k), float(v)) for k, v in enumerate([0.1, 0.3, -0.2, 0.4, 0.0])], "datetime date, ic double")
    r = hac.newey_west(df, reference="student", correct=False).first()
    assert (r.bandwidth_is_automatic, r.reference, r.small_sample_correction, r.prewhiten) == (True, "student", False, False)
    with pytest.raises(Exception, match="k_reg"):
        hac.newey_west(df, k_reg=5).collect()
    assert hac.newey_west(df.limit(2)).first().variance is None


def test_artifacts(tmp_path):
    store = Artifacts(tmp_path)
    assert set(KINDS) == {"mlruns", "predictions", "models", "reports", "figures", "tables"}
    assert store.folder("tables", "run1") == tmp_path / "tables" / "run1" and (tmp_path / "tables" / "run1").is_dir()
    for kind, run in (("logs", "x"), ("tables", ""), ("tables", "../x")):
        with pytest.raises(ValueError):
            store.folder(kind, run)
    payload = {"b": 1, "a": ["é", None]}
    assert store.save("x/doc.json", payload).read_text(encoding="utf-8") == '{\n  "a": [\n    "é",\n    null\n  ],\n  "b": 1\n}\n'
    assert store.load("x/doc.json") == payload and store.load(store.save("doc.yaml", payload)) == payload
    assert store.save("order.yaml", payload).read_text(encoding="utf-8").startswith("b: 1")
    assert content_hash({"a": 1, "b": 2}) == content_hash({"b": 2, "a": 1})
    assert store.addressed("stem", payload).name == f"stem-{content_hash(payload)[:12]}.json"
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        store.load("list.yaml")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["doc.yaml", "list.yaml", "order.yaml", "tables", "x"]


def test_streamed_publication_equals_one_publication(spark, tmp_path):
    days = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(k),) for k in range(10)], "datetime date")
    spec = pit.LagSpec(values=("v",))
    day = lambda k: dt.date(2024, 1, k)
    batches = [[("A", day(1), day(2), 1.0), ("B", day(1), day(3), 5.0)], [("A", day(2), day(6), 2.0)], [("A", day(1), day(4), 1.5), ("C", day(3), day(9), 7.0)]]
    schema = "instrument string, report_date date, announce_date date, v double"
    run = daily.publish_batches(days, spec, str(tmp_path))
    for n, rows in enumerate(batches):
        run(spark.createDataFrame(rows, schema), n)
    run(spark.createDataFrame(batches[2], schema), 2)  # again, as after a failure
    key = lambda df: sorted((r.instrument, r.datetime, r.pos, r.v) for r in df.collect())
    whole = pit.publish(spark.createDataFrame(sum(batches, []), schema), days, spec)
    assert key(daily.published(spark, str(tmp_path))) == key(whole)


def test_daily_panel(spark):
    rows = [(dt.datetime(2024, 1, d, h), u, v) for d, h, u, v in ((1, 3, 1, 2.0), (1, 23, 1, 3.0), (2, 0, 1, 4.0), (2, 5, 2, 1.0))]
    got = daily.daily_panel(spark.createDataFrame(rows, "ts timestamp, user_id bigint, value double")).collect()
    assert {(r.datetime.day, r.instrument, r.total, r.n) for r in got} == {(1, 1, 5.0, 2), (2, 1, 4.0, 1), (2, 2, 1.0, 1)}
