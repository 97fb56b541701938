"""Rank losses, and diagnostics of predictive distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.tails import normal_quantile

from .normalize import average_rank, with_date_figures

#: Intervals of probabilities within which values are ranked apart.
BINS = 4096


#: Terms of a smooth step's series within an interval of one temperature: its poles lie pi away, so that the rest is below 1e-16.
TERMS = 16
#: Intervals beyond which a smooth step is 0 or 1 to the last bit.
REACH = 40


def _chebyshev(u: Column) -> list[Column]:
    """The first TERMS Chebyshev polynomials at u, within -1 and 1."""
    return [F.cos(k * F.acos(u)) for k in range(TERMS)]


def _series_of_ranks(batches: Iterator) -> Iterator:
    """For each interval of a date, the series of the sum of smooth steps from all of the date's intervals, of (bins, moments): the
    polynomials' sums over each interval's scores, the first of which counts them."""
    import pandas as pd

    k = np.arange(TERMS)
    angle = np.pi * (k + 0.5) / TERMS
    nodes = np.cos(angle) / 2
    at_nodes = np.cos(np.outer(angle, k))  # polynomial of each node
    scale = np.where(k == 0, 1.0, 2.0) / TERMS
    for b in batches:
        for date, bins, moments in zip(b["datetime"], b["bins"], b["moments"], strict=True):
            order = np.argsort(bins)
            bins, m = np.asarray(bins)[order], np.stack([np.asarray(v, float) for v in moments])[order]
            weights = (m * scale) @ at_nodes.T  # each interval's scores, dealt to its nodes
            before = np.r_[0.0, np.cumsum(m[:, 0])]
            found = []
            for one in bins:
                lo, hi = np.searchsorted(bins, one - REACH), np.searchsorted(bins, one + REACH, "right")
                far = (one - bins[lo:hi])[:, None, None] + nodes[None, :, None] - nodes[None, None, :]
                values = before[lo] + np.einsum("btn,bn->t", 1 / (1 + np.exp(-far)), weights[lo:hi])
                found.append((scale * (values @ at_nodes)).tolist())
            yield pd.DataFrame({"datetime": [date] * len(bins), "bin": bins, "series": found})


def soft_rank_loss(pairs: DataFrame, temperature: float) -> DataFrame:
    """(datetime, instrument, soft_rank, loss): minus the product of the standardized smooth rank of score
    and rank of label, over the number of the date's pairs.

    A smooth rank is a sum over all scores of the date. Scores are taken together by intervals of one temperature, in which a smooth step is
    its Chebyshev series to the last bit: an interval is the sums of TERMS polynomials, and every score then reads its rank from its own interval's series, so
    that the work grows with the scores and not with their pairs. A date's intervals meet in one task; its scores don't.
    """
    if temperature <= 0:
        raise ValueError("the temperature has to be positive")
    full = pairs.dropna(subset=["score", "label"]).withColumn("_l", average_rank("label", ["datetime"], full=True))
    place = F.col("score").cast("double") / temperature
    full = full.withColumn("_bin", F.floor(place)).withColumn("_u", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (place - F.col("_bin")) - 1)))
    sums = full.groupBy("datetime", "_bin").agg(F.array(*map(F.sum, _chebyshev(F.col("_u")))).alias("m"))
    dates = sums.groupBy("datetime").agg(F.collect_list(F.struct("_bin", "m")).alias("v")).select("datetime", F.col("v._bin").alias("bins"), F.col("v.m").alias("moments"))
    series = dates.mapInPandas(_series_of_ranks, f"datetime {full.schema['datetime'].dataType.simpleString()}, bin bigint, series array<double>")
    read = sum((F.element_at("series", i + 1) * t for i, t in enumerate(_chebyshev(F.col("_u")))), F.lit(0.0))
    each = full.join(series.withColumnRenamed("bin", "_bin"), ["datetime", "_bin"]).select("datetime", "instrument", "_l", read.alias("soft_rank"))
    placed = with_date_figures(each, _n=F.count(F.lit(1)), _ms=F.avg("soft_rank"), _ds=F.stddev_samp("soft_rank"), _ml=F.avg("_l"), _dl=F.stddev_samp("_l"))
    z = lambda c, k: (F.col(c) - F.col(f"_m{k}")) / F.nullif(F.col(f"_d{k}"), F.lit(0.0))
    return placed.select("datetime", "instrument", "soft_rank", (-z("soft_rank", "s") * z("_l", "l") / F.col("_n")).alias("loss"))


def copula_loss(pairs: DataFrame) -> DataFrame:
    """(datetime, instrument, loss): minus the normal score of the label's rank times the standardized score. A normal
    score is found once for each rank and number of pairs, and joined."""
    full = pairs.dropna(subset=["score", "label"]).withColumn("_twice", (2 * average_rank("label", ["datetime"])).cast("bigint"))
    placed = with_date_figures(full, _n=F.count(F.lit(1)), _mean=F.avg("score"), _sd=F.stddev_samp("score"))
    keys = placed.select("_twice", "_n").distinct()
    scores = keys.withColumn("_q", normal_quantile(F.col("_twice") / (2 * (F.col("_n") + 1))))
    z = (F.col("score") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return placed.join(scores, ["_twice", "_n"]).select("datetime", "instrument", (-F.col("_q") * z).alias("loss"))


def pit_histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, n): probabilities within equal intervals, from 0; 1 is in the last one; empty bins are absent."""
    return df.where(F.col(col).between(0, 1)).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(col) * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ks_uniform(df: DataFrame, col: str) -> DataFrame:
    """One row (n, ks): largest distance of the empirical distribution from uniform.

    Equal values are counted first; those of an interval are then ranked apart and set off by the counts of
    the intervals before, so no task ranks all values.
    """
    values = df.where(F.col(col).between(0, 1)).groupBy(F.col(col).cast("double").alias("u")).agg(F.count(F.lit(1)).alias("c")).withColumn("bin", F.floor(F.col("u") * BINS))
    bins = values.groupBy("bin").agg(F.sum("c").alias("c"))
    before = bins.select("bin", (F.sum("c").over(Window.orderBy("bin")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    up = Window.partitionBy("bin").orderBy("u")
    ranked = values.join(F.broadcast(before), "bin").withColumn("k", F.sum("c").over(up) + F.col("before"))  # BINS rows
    far = F.greatest(F.col("k") / F.col("n") - F.col("u"), F.col("u") - (F.col("k") - F.col("c")) / F.col("n"))
    return ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.max(far).alias("ks"))


def interval_coverage(df: DataFrame, col: str, levels: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(level, n, covered): share of probabilities within the central interval of each level."""
    each = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_u"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    inside = (F.col("_u") >= (1 - F.col("level")) / 2) & (F.col("_u") <= (1 + F.col("level")) / 2)
    return each.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("covered"))
