"""Normalizers of panel columns. Those over time look strictly back; those over the cross-section use one date.

Each returns the panel with column ``out``. Dispersion of zero, and too little history, give null.
Time-series frames count rows, so the panel has to be dense with a position ``pos``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import by_date, by_name

#: Fixed value: median absolute deviation to standard deviation of a normal.
MAD_SCALE = 1.4826022
LENGTH, MIN_PERIODS, CLIP = 60, 20, 5.0


def clip(c: Column, bound: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), c)))


def _z(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.nullif(std, F.lit(0.0))


def _checked(length: int, min_periods: int) -> None:
    if length < 2 or not 1 <= min_periods <= length:
        raise ValueError("the window needs at least 2 rows and between 1 and that many observations")


def roll_z(df: DataFrame, col: str, out: str, *, length: int = LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """z-score by mean and sample deviation of the length rows before."""
    _checked(length, min_periods)
    w, x = by_name().rowsBetween(-length, -1), F.col(col)
    return df.withColumn(out, F.when(F.count(x).over(w) >= min_periods, _z(x, F.avg(x).over(w), F.stddev_samp(x).over(w))))


def roll_robust_z(df: DataFrame, col: str, out: str, *, length: int = LENGTH, min_periods: int = MIN_PERIODS, bound: float = CLIP) -> DataFrame:
    """z-score by the median of the history, and the rolling median of each past row's distance to its own median."""
    _checked(length, min_periods)
    w = by_name().rowsBetween(-(length - 1), 0)

    def median(c: str) -> Column:
        return F.when(F.count(c).over(w) >= min_periods, F.percentile(c, 0.5).over(w))

    past = df.withColumn("_past", F.lag(col).over(by_name())).withColumn("_med", median("_past"))
    dev = past.withColumn("_dev", F.abs(F.col("_past") - F.col("_med"))).withColumn("_mad", median("_dev"))
    return dev.withColumn(out, clip(_z(F.col(col), F.col("_med"), F.lit(MAD_SCALE) * F.col("_mad")), bound)).drop("_past", "_med", "_dev", "_mad")


def expanding_z(df: DataFrame, col: str, out: str, *, min_periods: int = MIN_PERIODS) -> DataFrame:
    """z-score by all rows before."""
    w, x = by_name().rowsBetween(Window.unboundedPreceding, -1), F.col(col)
    return df.withColumn(out, F.when(F.count(x).over(w) >= min_periods, _z(x, F.avg(x).over(w), F.stddev_samp(x).over(w))))


def average_rank(col: str, by: list[str], *, full: bool = False) -> Column:
    """Rank from 1 within by, ties sharing the mean of theirs; null for null. Ties are counted by the rank's own sort. full:
    there are no nulls, so that ranks of several columns share one exchange."""
    x = F.col(col)
    w = Window.partitionBy(*by, *([] if full else [x.isNull()])).orderBy(x)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / F.lit(2.0))


def cs_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Average rank over the number of observations plus 1."""
    return df.withColumn(out, average_rank(col, ["datetime"]) / (F.count(col).over(by_date()) + F.lit(1.0)))


def with_date_figures(df: DataFrame, **figures: Column) -> DataFrame:
    """df with aggregates of its dates as columns. Tasks combine their parts of a date, and the dates' single rows, bounded by
    the calendar, are broadcast: no date's cross-section meets in one task."""
    return df.join(F.broadcast(df.groupBy("datetime").agg(*[v.alias(k) for k, v in figures.items()])), "datetime")


def cs_z(df: DataFrame, col: str, out: str) -> DataFrame:
    """z-score by the date's mean and sample deviation."""
    placed = with_date_figures(df, _mean=F.avg(col), _sd=F.stddev_samp(col))
    return placed.withColumn(out, _z(F.col(col), F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def cs_robust_z(df: DataFrame, col: str, out: str, *, bound: float = CLIP) -> DataFrame:
    """z-score by the date's median and median absolute deviation."""
    med = df.withColumn("_med", F.percentile(col, 0.5).over(by_date())).withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    return med.withColumn(out, clip(_z(F.col(col), F.col("_med"), F.lit(MAD_SCALE) * F.percentile("_dev", 0.5).over(by_date())), bound)).drop("_med", "_dev")


def cs_standardize(df: DataFrame, col: str, out: str) -> DataFrame:
    """By mean and population deviation; a date without dispersion is 0."""
    placed = with_date_figures(df, _mean=F.avg(col), _sd=F.stddev_pop(col))
    return placed.withColumn(out, (F.col(col) - F.col("_mean")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))).drop("_mean", "_sd")


def global_z(df: DataFrame, col: str, out: str, *, allow_leaky: bool = False) -> DataFrame:
    """z-score by each instrument's whole sample: sees the future, so it has to be asked for."""
    if not allow_leaky:
        raise ValueError("global_z uses the future; pass allow_leaky=True for a negative control")
    w = Window.partitionBy("instrument")
    return df.withColumn(out, _z(F.col(col), F.avg(col).over(w), F.stddev_samp(col).over(w)))


def winsorize(df: DataFrame, col: str, out: str, q: float) -> DataFrame:
    """Clip to the date's linear quantiles q and 1 - q."""
    if not 0 <= q < 0.5:
        raise ValueError("q has to be in [0, 0.5)")
    lo, hi = (F.percentile(col, p).over(by_date()) for p in (q, 1 - q))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), F.greatest(lo, F.least(hi, F.col(col)))))


#: Name -> normalizer, for processor specifications.
PROCESSORS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (roll_z, roll_robust_z, expanding_z, cs_rank, cs_z, cs_robust_z, global_z)}


def build_processor(spec: Mapping[str, Any]) -> Callable[[DataFrame, str, str], DataFrame]:
    """{"class": name, "kwargs": {...}} -> a function of (panel, column, out)."""
    kwargs = spec.get("kwargs") or {}
    if not isinstance(kwargs, Mapping):
        raise TypeError("kwargs has to be a mapping")
    if spec["class"] not in PROCESSORS:
        raise KeyError(f"unknown processor {spec['class']!r}; known: {', '.join(sorted(PROCESSORS))}")
    f = PROCESSORS[spec["class"]]
    return lambda df, col, out: f(df, col, out, **kwargs)


def fit_robust(train: DataFrame, cols: list[str], *, accuracy: int | None = None) -> DataFrame:
    """One row of a training window: for each column its median and 1.4826022 * median absolute deviation, as
    <col>_median and <col>_scale. Exact, or with ``accuracy`` by percentile_approx, for windows of too many distinct values for one task."""
    half = (lambda c: F.percentile_approx(c, 0.5, accuracy)) if accuracy else (lambda c: F.percentile(c, 0.5))
    middle = F.broadcast(train.agg(*[half(F.col(c)).alias(f"_m_{c}") for c in cols]))  # one row
    spread = train.select(*cols).crossJoin(middle)
    return spread.agg(*[x for c in cols for x in (F.first(f"_m_{c}").alias(f"{c}_median"), (1.4826022 * half(F.abs(F.col(c) - F.col(f"_m_{c}")))).alias(f"{c}_scale"))])


def apply_robust(df: DataFrame, fitted: DataFrame, cols: list[str], *, limit: float = 3.0, fill: float | None = None) -> DataFrame:
    """The columns by what fit_robust found on the training window, clipped to +-limit; missing values, and all where the scale
    is 0, become fill."""
    out = df.crossJoin(F.broadcast(fitted))  # one row
    z = lambda c: clip((F.col(c) - F.col(f"{c}_median")) / F.nullif(F.col(f"{c}_scale"), F.lit(0.0)), limit)
    return out.withColumns({c: z(c) if fill is None else F.coalesce(z(c), F.lit(fill)) for c in cols}).drop(*fitted.columns)
