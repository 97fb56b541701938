"""Mean-variance weights against all active sets of small programs."""

import itertools
import math

import numpy as np
import pytest

from panelgrid.operators import optimize


def program_of(seed, n):
    r = np.random.default_rng(seed)
    x = r.normal(size=(3 * n, n))
    cov = x.T @ x / (3 * n)
    previous = r.dirichlet(np.ones(n))
    return cov, r.normal(0, 0.4, n), previous, np.zeros(n), np.full(n, 0.6)


def frames(spark, cov, mu, previous, lower, upper):
    n = len(mu)
    names = spark.createDataFrame([(f"n{i}", float(mu[i]), float(previous[i]), float(lower[i]), float(upper[i])) for i in range(n)], "instrument string, mu double, previous double, lower double, upper double")
    pairs = spark.createDataFrame([(f"n{i}", f"n{j}", float(cov[i, j])) for i in range(n) for j in range(i, n)], "a string, b string, cov double")
    return names, pairs


def value(w, cov, mu, previous, p):
    d = w - previous
    return 0.5 * p.risk_aversion * w @ cov @ w - mu @ w + p.buy * np.maximum(d, 0).sum() + p.sell * np.maximum(-d, 0).sum() + 0.5 * p.shrinkage * (w @ w)


def best_of_active_sets(cov, mu, previous, lower, upper, p, equal=None):
    """Every name at a bound, at its previous weight, or free while bought or sold: the conditions of each case are linear."""
    n, best = len(mu), math.inf
    rows = np.ones((1, n)) if equal is None else np.vstack([np.ones(n), equal])
    right = np.r_[p.budget, np.zeros(len(rows) - 1)]
    hessian = p.risk_aversion * cov + p.shrinkage * np.eye(n)
    for case in itertools.product("LUPBS", repeat=n):
        fixed = {"L": lower, "U": upper, "P": previous}
        free = [i for i in range(n) if case[i] in "BS"]
        w = np.array([fixed[c][i] if c in fixed else 0.0 for i, c in enumerate(case)])
        if free:
            slope = np.array([p.buy if case[i] == "B" else -p.sell for i in free])
            kkt = np.block([[hessian[np.ix_(free, free)], rows[:, free].T], [rows[:, free], np.zeros((len(rows),) * 2)]])
            known = np.r_[mu[free] - slope - (hessian @ w)[free], right - rows @ w]
            w[free] = np.linalg.lstsq(kkt, known, rcond=None)[0][: len(free)]
        if (w >= lower - 1e-9).all() and (w <= upper + 1e-9).all() and np.abs(rows @ w - right).max() < 1e-8:
            best = min(best, value(w, cov, mu, previous, p))
    return best


@pytest.mark.parametrize(("seed", "kwargs"), [(1, {}), (2, {"buy": 0.3, "sell": 0.1, "shrinkage": 0.5}), (3, {"risk_aversion": 8.0})])
def test_gap_to_the_best_active_set(spark, seed, kwargs):
    data, p = program_of(seed, 5), optimize.Program(**kwargs)
    got = optimize.mean_variance(*frames(spark, *data), p)
    cov, mu, previous, lower, upper = data
    w = np.array([r.weight for r in got.weights.orderBy("instrument").collect()])
    best = best_of_active_sets(*data, p)
    assert got.status == "optimal" and w.sum() == pytest.approx(1, abs=1e-9) and (w >= -1e-12).all() and (w <= 0.6 + 1e-12).all()
    assert got.objective == pytest.approx(value(w, cov, mu, previous, p), abs=1e-9)
    assert -1e-9 <= got.objective - best <= got.gap + 1e-9 and got.gap <= 1e-6


def test_neutral_weights(spark):
    data, p = program_of(4, 5), optimize.Program(buy=0.0, sell=0.0, budget=0.0)
    cov, mu, previous, _, upper = data
    lower, exposed = -upper, np.array([1.0, 1.0, -1.0, 0.5, 0.0])
    exposures = spark.createDataFrame([(f"n{i}", "f", float(x)) for i, x in enumerate(exposed)], "instrument string, factor string, exposure double")
    got = optimize.mean_variance(*frames(spark, cov, mu, previous, lower, upper), p, exposures=exposures)
    w = np.array([r.weight for r in got.weights.orderBy("instrument").collect()])
    assert abs(exposed @ w) < 1e-8 and abs(w.sum()) < 1e-9
    assert got.objective == pytest.approx(best_of_active_sets(cov, mu, previous, lower, upper, p, exposed[None]), abs=1e-6)


def test_caps_bind_and_cost_something(spark):
    data = program_of(5, 6)
    cov, mu, previous, _, upper = data
    lower, last = -upper, -math.inf
    for kwargs in ({}, {"turnover": 0.9}, {"turnover": 0.3}, {"turnover": 0.3, "gross": 1.05}):
        got = optimize.mean_variance(*frames(spark, cov, mu, previous, lower, upper), optimize.Program(buy=0.01, sell=0.01, **kwargs))
        w = np.array([r.weight for r in got.weights.orderBy("instrument").collect()])
        assert np.abs(w - previous).sum() <= kwargs.get("turnover", 99) + 1e-8 and np.abs(w).sum() <= kwargs.get("gross", 99) + 1e-8
        assert got.gap <= 1e-6 and got.objective >= last - 1e-7 and w.sum() == pytest.approx(1, abs=1e-8)
        last = got.objective


def test_caps_give_way_in_order(spark):
    cov, mu, previous, lower, upper = program_of(6, 4)
    previous = np.array([0.7, 0.1, 0.1, 0.1])  # above its bound: a tenth has to be sold, and bought elsewhere
    run = lambda **kwargs: optimize.mean_variance(*frames(spark, cov, mu, previous, lower, upper), optimize.Program(**kwargs))
    assert run(turnover=0.2).fallbacks == []
    relaxed = run(turnover=0.15)
    assert (relaxed.status, relaxed.fallbacks) == ("relaxed", ["turnover"])
    held = run(turnover=0.1)
    assert (held.status, held.fallbacks) == ("held", ["turnover", "degenerate_rebalance"])
    assert [r.weight for r in held.weights.orderBy("instrument").collect()] == previous.tolist()
    assert run(budget=9.0).status == "held"
    # exposures that can't be neutral with weights of one sign become a penalty
    exposures = spark.createDataFrame([(f"n{i}", "f", 1.0 + i) for i in range(4)], "instrument string, factor string, exposure double")
    soft = optimize.mean_variance(*frames(spark, cov, mu, previous, lower, upper), optimize.Program(neutrality_penalty=50.0), exposures=exposures)
    w = np.array([r.weight for r in soft.weights.orderBy("instrument").collect()])
    assert soft.fallbacks == ["neutrality"] and w[0] == pytest.approx(0.6, abs=1e-6) and w[1] == pytest.approx(0.4, abs=1e-6)


def test_what_cannot_be_traded(spark):
    cov, mu, previous, lower, upper = program_of(7, 5)
    names, pairs = frames(spark, cov, mu, previous, lower, upper)
    from pyspark.sql import functions as F

    names = names.withColumns({"tradable": F.col("instrument") != "n0", "capacity": F.when(F.col("instrument") == "n1", 0.01).otherwise(1.0)})
    got = optimize.mean_variance(names, pairs, optimize.Program(risk_aversion=2.0))
    w = {r.instrument: r.weight for r in got.weights.collect()}
    assert w["n0"] == 0 and abs(w["n1"] - previous[1]) <= 0.01 + 1e-12 and sum(w.values()) == pytest.approx(1)
    assert optimize.mean_variance(names.limit(0), pairs).status == "held"
    with pytest.raises(ValueError):
        optimize.Program(risk_aversion=0)
