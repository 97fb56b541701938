"""The risk queries over every user of a panel, against NumPy."""

import datetime as dt

import numpy as np
import pytest

import __spark_entry__ as entry

USERS, DAYS = 24, 9


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    r = np.random.default_rng(4)
    x = np.where(r.random((DAYS, USERS)) < 0.8, r.normal(size=(DAYS, USERS)) * 10, np.nan)
    rows = [(dt.datetime(2024, 1, 1 + t, 12), u, float(v)) for (t, u), v in np.ndenumerate(x) if not np.isnan(v)]
    spark.createDataFrame(rows, "ts timestamp, user_id bigint, value double").write.parquet(f"{folder}/events.parquet")
    return folder, x


def shrunk(x):
    z = np.nan_to_num(x - np.nanmean(x, 0))
    t, n = z.shape
    s = z.T @ z / t
    d2 = ((s - np.trace(s) / n * np.eye(n)) ** 2).sum()
    b2 = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / t**2
    delta = min(b2, d2) / d2
    return (1 - delta) * s + delta * np.trace(s) / n * np.eye(n), delta


def test_covariance_of_every_user(spark, events):
    folder, x = events
    got = {(r.a, r.b): (r.n, r["cov"]) for r in entry.queries()["covariance"](spark, folder).collect()}
    both = {(a, b): ~np.isnan(x[:, a]) & ~np.isnan(x[:, b]) for a in range(USERS) for b in range(a, USERS)}
    want = {k: (int(m.sum()), pytest.approx(np.cov(x[m][:, k[0]], x[m][:, k[1]])[0, 1], abs=1e-4)) for k, m in both.items() if m.sum() >= 5}
    assert got == want and max(b for _, b in got) == USERS - 1


def test_shrinkage_and_target_of_every_user(spark, events):
    folder, x = events
    want, delta = shrunk(x)
    got = {(r.a, r.b): (r["cov"], r.delta) for r in entry.queries()["ledoit_wolf"](spark, folder).collect()}
    assert got == {(a, b): (pytest.approx(want[a, b], abs=1e-4), pytest.approx(delta, abs=1e-6)) for a in range(USERS) for b in range(a, USERS)}
    weights = {(r.datetime.day - 1, r.instrument): r.weight for r in entry.queries()["volatility_target"](spark, folder).collect()}
    held = ~np.isnan(x)
    for t in range(DAYS):
        w = held[t] / held[t].sum()
        w = w * 10 / np.sqrt(w @ want @ w)
        assert {u: v for (d, u), v in weights.items() if d == t} == {u: pytest.approx(w[u], abs=1e-5) for u in range(USERS) if held[t, u]}
