"""Panels with a known relation of score and label, generated where they are used."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.operators.normalize import cs_standardize

#: A Monday, from which business days are counted, and the noise's periods before it.
FIRST_DAY, BURN_IN = "2000-01-03", 200


@dataclass(frozen=True)
class PanelSpec:
    instruments: int = 100
    days: int = 1000
    features: int = 3
    feature_kind: str = "ar1"
    feature_rho: float = 0.95
    signal_kind: str = "linear"
    correlation: float = 0.05
    noise_df: float = 5.0
    noise_rho: float = 0.3
    seed: int = 20260926

    def __post_init__(self) -> None:
        wrong = {
            "instruments": self.instruments < 3,
            "days": self.days < 3,
            "features": not (3 if self.signal_kind == "nonlinear" else 1) <= self.features <= 5,
            "feature_kind": self.feature_kind not in ("ar1", "random_walk"),
            "feature_rho": not 0 <= self.feature_rho <= 1,
            "signal_kind": self.signal_kind not in ("linear", "nonlinear"),
            "correlation": not 0 <= self.correlation < 1,
            "noise_df": self.noise_df <= 2,
            "noise_rho": not 0 <= self.noise_rho < 1,
            "seed": self.seed < 0,
        }
        if any(wrong.values()):
            raise ValueError(f"out of range: {', '.join(k for k, bad in wrong.items() if bad)}")

    @property
    def beta(self) -> float:
        """Loading of the signal at which it has the wanted correlation, with noise of variance 1."""
        return self.correlation / math.sqrt(1 - self.correlation**2)

    @property
    def copula_rank_ic(self) -> float:
        return 6 / math.pi * math.asin(self.correlation / 2)


def _recursion(shocks: np.ndarray, rho: float) -> np.ndarray:
    """x[0] = shocks[0], x[t] = rho x[t-1] + shocks[t], along the first axis."""
    return np.stack(list(accumulate(shocks, lambda x, e: rho * x + e)))


def _noise(rng: np.random.Generator, spec: PanelSpec) -> np.ndarray:
    """Shocks of the noise, of variance 1, from before the panel begins."""
    shocks = rng.standard_t(spec.noise_df, BURN_IN + spec.days) * math.sqrt((spec.noise_df - 2) / spec.noise_df)
    shocks[1:] *= math.sqrt(1 - spec.noise_rho**2)
    return shocks


def _drawn(spark: SparkSession, spec: PanelSpec, draws: int) -> DataFrame:
    """(datetime, pos, instrument, f0.., score, noises): noises has the panel's own noise and then that of each further draw. An
    instrument's draws are made where its features are, so they are never joined."""
    names = [f"f{k}" for k in range(spec.features)]
    walk = spec.feature_kind == "random_walk"
    rho = 1.0 if walk else spec.feature_rho
    scale = 1.0 if walk else math.sqrt(1 - rho * rho)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for i in b["id"]:
                rng = np.random.default_rng([spec.seed, int(i)])
                shocks = rng.standard_normal((spec.days, spec.features))
                shocks[1:] *= scale
                noise = np.column_stack([_noise(rng, spec), *(_noise(np.random.default_rng([spec.seed, int(i), d]), spec) for d in range(1, draws + 1))])
                out = pd.DataFrame(_recursion(shocks, rho), columns=names)
                yield out.assign(id=i, pos=np.arange(spec.days), noises=list(_recursion(noise, spec.noise_rho)[BURN_IN:]))

    rows = spark.range(spec.instruments).mapInPandas(run, ", ".join([*(f"{n} double" for n in names), "id bigint", "pos bigint", "noises array<double>"]))
    w = [float(x) / math.sqrt(spec.features) for x in np.random.default_rng([spec.seed, 2**40]).standard_normal(spec.features)]
    f = [F.col(n) for n in names]
    if spec.signal_kind == "linear":
        raw = sum((a * b for a, b in zip(w, f, strict=True)), F.lit(0.0))
    else:
        raw = F.tanh(w[0] * f[0]) + w[1] * f[0] * f[1] + w[2] * f[2]
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (F.floor(F.col("pos") / 5) * 7 + F.col("pos") % 5).cast("int"))
    named = rows.select(day.alias("datetime"), "pos", F.format_string("S%04d", "id").alias("instrument"), *names, "noises", raw.alias("_raw"))
    return cs_standardize(named, "_raw", "score").drop("_raw")


def generate(spark: SparkSession, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """(datetime, pos, instrument, f0.., score, noise, label): label = beta * score + noise, the score
    being of mean 0 and variance 1 on each date. Every instrument draws from a generator of its own, seeded by the
    spec and its number, so a panel doesn't depend on the number of tasks."""
    panel = _drawn(spark, spec, 0).withColumn("noise", F.element_at("noises", 1)).drop("noises")
    names = [f"f{k}" for k in range(spec.features)]
    return panel.select("datetime", "pos", "instrument", *names, "noise", "score").withColumn("label", spec.beta * F.col("score") + F.col("noise"))


def ic_of_draws(spark: SparkSession, spec: PanelSpec, draws: int, *, ranked: bool = True) -> DataFrame:
    """(draw, datetime, n, ic) of labels with the panel's own noise (draw 0) and of as many draws of new noise on the same score."""
    from panelgrid.operators.ic import pearson_ic, rank_ic

    every = _drawn(spark, spec, draws).select("datetime", "instrument", "score", F.posexplode("noises").alias("draw", "noise")).withColumn("label", spec.beta * F.col("score") + F.col("noise"))
    dated = every.select(F.struct("draw", "datetime").alias("datetime"), "instrument", "score", "label")
    return (rank_ic if ranked else pearson_ic)(dated, min_obs=3).select("datetime.draw", "datetime.datetime", "n", "ic")


def ground_truth(spark: SparkSession, spec: PanelSpec = PanelSpec(), *, draws: int = 20) -> DataFrame:
    """One row of what a generated panel holds: the population correlation and its loading, the realized mean and deviation of rank
    ICs and the mean of linear ones, the rank IC of a normal copula, the rank IC to expect given the score (mean over dates of all draws
    of new noise, null without any) with its standard error over draws, excess kurtosis of noise (of its shocks, where it exists, and measured)
    and label, and the ICs' lag-1 autocorrelation."""
    from panelgrid.operators.hac import lag1_autocorrelation

    found = ic_of_draws(spark, spec, draws)
    ics = spark.createDataFrame(found.collect(), found.schema)  # one row for each date and draw, made once for what follows
    own, others = ics.where("draw = 0"), ics.where("draw > 0")
    panel = generate(spark, spec)
    realized = own.agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("realized_mean_rank_ic"), F.stddev_samp("ic").alias("realized_rank_ic_std"))
    by_draw = others.groupBy("draw").agg(F.avg("ic").alias("m"))
    expected = by_draw.agg(F.avg("m").alias("expected_rank_ic"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("expected_rank_ic_error"), F.count("m").alias("draws"))
    linear = ic_of_draws(spark, spec, 0, ranked=False).agg(F.avg("ic").alias("realized_mean_pearson_ic"))
    tails = panel.agg(F.kurtosis("noise").alias("noise_kurtosis"), F.kurtosis("label").alias("label_kurtosis"), F.count(F.lit(1)).alias("n_observations"))
    again = lag1_autocorrelation(own).select(F.col("acf1").alias("ic_acf1"))
    known = [F.lit(spec.correlation).alias("population_correlation"), F.lit(spec.beta).alias("signal_loading"), F.lit(spec.copula_rank_ic).alias("copula_rank_ic"), F.lit(6 / (spec.noise_df - 4) if spec.noise_df > 4 else None).cast("double").alias("shock_kurtosis")]
    one = realized
    for more in (expected, linear, tails, again):
        one = one.crossJoin(F.broadcast(more))  # one row each
    return one.select(*known, *one.columns)
