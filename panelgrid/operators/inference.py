"""Quantile portfolios, multiple testing and comparison of forecasts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .grid import by_name, calendar, fixed, instruments
from .hac import newey_west
from .normalize import average_rank


def quantile_returns(pairs: DataFrame, q: int, *, weight: str | None = None) -> DataFrame:
    """(datetime, bucket, n, ret): bucket = ceil(q * rank / n) by score; equal or value weighted mean label. Weights
    are those of the instrument's row before, in the order of pos; a missing one counts nothing."""
    if q < 2:
        raise ValueError("two buckets at least")
    if weight:
        pairs = pairs.withColumn("_weight", F.lag(weight).over(by_name()))
    full = pairs.dropna(subset=["score", "label"])
    ranked = full.withColumn("_r", average_rank("score", ["datetime"])).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("datetime")))
    w = F.coalesce(F.col("_weight").cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    dealt = ranked.withColumn("bucket", F.least(F.lit(q), F.ceil(q * F.col("_r") / F.col("_n"))).cast("int"))
    return dealt.groupBy("datetime", "bucket").agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col("label")) / F.nullif(F.sum(w), F.lit(0.0))).alias("ret"))


def long_short(buckets: DataFrame, q: int) -> DataFrame:
    """(datetime, spread): top bucket less bottom bucket, of dates that have both."""
    side = lambda k: F.max(F.when(F.col("bucket") == k, F.col("ret")))
    return buckets.groupBy("datetime").agg((side(q) - side(1)).alias("spread")).where("spread is not null")


def diebold_mariano(pairs: DataFrame, a: str, b: str, *, horizon: int, order: str = "datetime", squared: bool = True, p_value: bool = True) -> DataFrame:
    """HAC test of the mean difference of two per-date losses; bandwidth max(automatic, floor(1.5 horizon)). The bandwidth
    follows from the series where it is tested, so it is computed once."""
    loss = (lambda c: F.col(c) * F.col(c)) if squared else (lambda c: F.abs(c))
    d = pairs.select(order, (loss(a) - loss(b)).alias("d")).where("d is not null")
    return newey_west(d, col="d", order=order, least_bandwidth=math.floor(1.5 * horizon), p_value=p_value)


#: Intervals of p-values within which they are ranked apart.
BINS = 4096


def _counted(tests: DataFrame, p: str) -> DataFrame:
    """(p, c, k, m, bin): the distinct p-values with their number, the number up to and including them, and of all. Those of an interval
    are counted apart and set off by the counts of the intervals before, so no task sees them all."""
    values = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("c")).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(F.col("p") * BINS))))
    bins = values.groupBy("bin").agg(F.sum("c").alias("_c"))
    before = bins.select("bin", (F.sum("_c").over(Window.orderBy("bin")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("m"))
    placed = values.join(F.broadcast(before), "bin")  # BINS rows
    return placed.withColumn("k", F.col("_before") + F.sum("c").over(Window.partitionBy("bin").orderBy("p"))).drop("_before")


def _extreme(counted: DataFrame, own: Column, out: str, *, largest: bool) -> DataFrame:
    """(p, out): the largest of own over this and all smaller p-values, or the least over this and all larger ones; at most 1."""
    pick, order = (F.max, F.col("p").asc()) if largest else (F.min, F.col("p").desc())
    each = counted.withColumn("_own", own)
    bins = each.groupBy("bin").agg(pick("_own").alias("_own"))
    beyond = Window.orderBy(F.col("bin").asc() if largest else F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    others = bins.select("bin", pick("_own").over(beyond).alias("_far"))
    near = pick("_own").over(Window.partitionBy("bin").orderBy(order))
    both = F.greatest(near, "_far") if largest else F.least(near, "_far")
    return each.join(F.broadcast(others), "bin").select(F.col("p").alias("_p"), F.least(F.lit(1.0), both).alias(out))  # BINS rows


def benjamini_hochberg(tests: DataFrame, *, p: str = "p") -> DataFrame:
    """Adds p_bh: the least of p * m / rank over this and all larger p-values, at most 1. A missing p is no test and stays missing."""
    found = _extreme(_counted(tests, p), F.col("p") * F.col("m") / F.col("k"), "p_bh", largest=False)
    return tests.join(found, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")


def holm(tests: DataFrame, *, p: str = "p") -> DataFrame:
    """Adds p_holm: the largest of p * (m - rank + 1) over this and all smaller p-values, at most 1. A missing p is no test and stays missing."""
    found = _extreme(_counted(tests, p), F.col("p") * (F.col("m") - (F.col("k") - F.col("c"))), "p_holm", largest=True)
    return tests.join(found, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")


def beta_by_date(pairs: DataFrame) -> DataFrame:
    """(datetime, n, beta): slope of label on score; null without dispersion."""
    full = pairs.dropna(subset=["score", "label"])
    return full.groupBy("datetime").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("score", "label"), F.nullif(F.var_pop("score"), F.lit(0.0))).alias("beta"))


def gaussian_nll(df: DataFrame, y: str, mean: str, sd: str, out: str = "nll") -> DataFrame:
    z = (F.col(y) - F.col(mean)) / F.nullif(F.col(sd), F.lit(0.0))
    return df.withColumn(out, 0.5 * math.log(2 * math.pi) + F.log(F.col(sd)) + 0.5 * z * z)


def student_nll(df: DataFrame, y: str, mean: str, scale: str, nu: str, out: str = "nll") -> DataFrame:
    from panelgrid.functions.tails import log_gamma

    z, v = (F.col(y) - F.col(mean)) / F.nullif(F.col(scale), F.lit(0.0)), F.col(nu)
    return df.withColumn(out, log_gamma(v / 2) - log_gamma((v + 1) / 2) + 0.5 * F.log(math.pi * v) + F.log(F.col(scale)) + (v + 1) / 2 * F.log1p(z * z / v))


def masked_mean_nll(df: DataFrame, nll: str, mask: str, weight: str | None = None) -> DataFrame:
    """One row (n, objective): the weighted mean of nll over the masked rows that have one; null where there is none."""
    on = F.coalesce(F.col(mask), F.lit(False)) & F.col(nll).isNotNull() & ~F.isnan(nll)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return df.agg(F.count_if(on).alias("n"), F.try_divide(F.sum(F.when(on, w * F.col(nll))), F.nullif(F.sum(F.when(on, w)), F.lit(0.0))).alias("objective"))


def covariance(df: DataFrame, col: str, *, min_obs: int = 2) -> DataFrame:
    """(a, b, n, cov) of instruments over their common dates, a <= b; pairs are made by tiles of instruments and never shuffled."""
    days, n_days = fixed(calendar(df))
    rows = blocks.series(df.select("datetime", "instrument", col).join(F.broadcast(days), "datetime"), col)

    def given(x: np.ndarray) -> tuple:
        # relative to the instrument's mean: the covariance is the same, and the sums small
        return np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True)), ~np.isnan(x) * 1.0

    def found(left: tuple, right: tuple) -> Iterator:
        (x, m), (y, k) = left, right
        n = m @ k.T
        p, q = np.nonzero(n >= max(1, min_obs))
        n = n[p, q]
        cov = ((x @ y.T)[p, q] - (x @ k.T)[p, q] * (m @ y.T)[p, q] / n) / np.where(n > 1, n - 1, np.nan)
        yield p, q, n.astype("int64"), cov

    out = blocks.pairs(rows, instruments(df), n_days, given, found, "n bigint, cov double")
    return out.withColumn("cov", F.when(F.col("n") > 1, F.col("cov")))


def mean_gap(series: DataFrame, *, periods_per_year: float = 252) -> DataFrame:
    """One row (n, mean_gap, per_year) of dates with their calendar positions: the mean step, and how many such steps a year has."""
    steps = series.select((F.col("pos") - F.lag("pos").over(Window.orderBy("pos"))).alias("d"))
    return steps.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_gap"), F.try_divide(F.lit(float(periods_per_year)), F.avg("d")).alias("per_year"))


def residualize(df: DataFrame, col: str, exposures: list[str], out: str = "residual") -> DataFrame:
    """Adds what is left of col after a regression with intercept on the exposures of its date; null where any of them
    is missing. Dates come together as sums of products only, from which each date's coefficients are found; those
    rows, one a date, are broadcast. Exposures that depend on each other give the same residual as without the surplus ones."""
    names = [col, *exposures]
    full = F.lit(True)
    for c in names:
        full = full & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.withColumn("_full", full)
    centred = rows.where("_full").groupBy("datetime").agg(F.array(*[F.avg(F.col(c).cast("double")) for c in names]).alias("_mean"), F.array(*[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for a in names for b in names]).alias("_cov"))
    k = len(names)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            found = []
            for mean, cov in zip(b["_mean"], b["_cov"], strict=True):
                mean, cov = np.asarray(mean), np.asarray(cov).reshape(k, k)
                scale = np.sqrt(np.diag(cov)[1:])
                scale[scale == 0] = 1.0
                beta = np.linalg.lstsq(cov[1:, 1:] / np.outer(scale, scale), cov[1:, 0] / scale, rcond=1e-10)[0] / scale
                found.append([float(mean[0] - beta @ mean[1:]), *map(float, beta)])
            yield b[["datetime"]].assign(_beta=found)

    kind = df.schema["datetime"].dataType.simpleString()
    fitted = F.broadcast(centred.mapInPandas(run, f"datetime {kind}, _beta array<double>"))
    value = F.col(col) - F.element_at("_beta", 1)
    for i, c in enumerate(exposures):
        value = value - F.element_at("_beta", i + 2) * F.col(c)
    return rows.join(fitted, "datetime", "left").withColumn(out, F.when(F.col("_full"), value)).drop("_full", "_beta")


def block_length(series: DataFrame, *, col: str, order: str = "datetime", method: str = "circular_block") -> float:
    """Length of blocks, or their mean length for the stationary bootstrap, by the flat-top rule of Politis and White (2004, corrected
    2009): lags up to twice the last that stands out of 2 sqrt(log10(n) / n) count. 1 for a series without dispersion or of
    fewer than 4 values. Only the autocovariances, some sqrt(n) rows, come to the driver."""
    from .hac import autocovariances

    shrink = {"circular_block": 4 / 3, "stationary": 2.0}[method]
    kept = series.where(F.col(col).isNotNull())
    n = kept.count()
    if n < 4:
        return 1.0
    run = max(5, math.ceil(math.sqrt(math.log10(n))))
    last = min(math.ceil(math.sqrt(n)) + run, n - 1)
    gamma = {r["lag"]: r["gamma"] for r in autocovariances(kept, last, col=col, order=order).collect()}
    if not gamma.get(0):
        return 1.0
    bound = 2 * math.sqrt(math.log10(n) / n)
    quiet = [abs(gamma.get(k, 0.0) / gamma[0]) < bound for k in range(1, last + 1)]
    m = next((k for k in range(last) if all(quiet[k : k + run])), last)
    top = min(2 * max(m, 1), last)
    flat = {k: min(1.0, 2 * (1 - k / top)) for k in range(1, top + 1)}
    g = 2 * sum(w * k * gamma.get(k, 0.0) for k, w in flat.items())
    level = gamma[0] + 2 * sum(w * gamma.get(k, 0.0) for k, w in flat.items())
    b = (2 * g * g / (shrink * level * level)) ** (1 / 3) * n ** (1 / 3) if level else 1.0
    return min(max(b, 1.0), math.ceil(min(3 * math.sqrt(n), n / 3)))
