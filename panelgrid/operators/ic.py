"""Information coefficients: per-date correlation of a score with a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import KEYS
from .normalize import average_rank

MIN_OBS, PERIODS_PER_YEAR = 30, 252


def align(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(datetime, instrument, score, label) of the keys that have both."""
    return scores.select(*KEYS, "score").join(labels.select(*KEYS, "label"), KEYS).dropna()


def _correlation(df: DataFrame, x: str, y: str, *, least: int = 1, keep_flat: bool = False) -> DataFrame:
    """(datetime, n, ic) of the dates with at least ``least`` rows, by one aggregate that tasks combine; a flat side gives
    null instead of an error."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    out = df.groupBy("datetime").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))).alias("ic")).where(F.col("n") >= least)
    return out if keep_flat else out.where("ic is not null")


def _checked(min_obs: int) -> int:
    if min_obs < 3:
        raise ValueError("min_obs has to be 3 at least")
    return min_obs


def pearson_ic(pairs: DataFrame, *, min_obs: int = MIN_OBS) -> DataFrame:
    """pairs: (datetime, instrument, score, label). Dates with fewer pairs, or without dispersion, have no row."""
    return _correlation(pairs.dropna(subset=["score", "label"]), "score", "label", least=_checked(min_obs))


def rank_ic(pairs: DataFrame, *, min_obs: int = MIN_OBS) -> DataFrame:
    """Correlation of average ranks, taken after incomplete pairs are gone; thin dates have no row."""
    full = pairs.dropna(subset=["score", "label"])
    ranked = full.select("datetime", average_rank("score", ["datetime"], full=True).alias("rs"), average_rank("label", ["datetime"], full=True).alias("rl"))
    return _correlation(ranked, "rs", "rl", least=_checked(min_obs))


def dropped_dates(pairs: DataFrame, *, min_obs: int = MIN_OBS) -> DataFrame:
    """One row: dates seen with too few pairs."""
    return pairs.dropna(subset=["score", "label"]).groupBy("datetime").count().agg(F.count_if(F.col("count") < min_obs).alias("n_dropped"))


def per_date_correlation(df: DataFrame, x: str, y: str, *, ranked: bool = False) -> DataFrame:
    """Correlation per date without a least number; ranks break ties by instrument; flat dates keep a null."""
    from pyspark.sql import Window

    df = df.dropna(subset=[x, y])
    if ranked:
        place = lambda c: F.row_number().over(Window.partitionBy("datetime").orderBy(c, "instrument")).cast("double")
        df = df.select("datetime", place(x).alias("_x"), place(y).alias("_y"))
        x, y = "_x", "_y"
    return _correlation(df, x, y, keep_flat=True)


def moments(ic: DataFrame, *, col: str = "ic", periods_per_year: int = PERIODS_PER_YEAR) -> DataFrame:
    """One row: n_obs, mean, std, icir, icir_annual, t_iid. Under two values all but n_obs are null; without dispersion the ratios."""
    one = ic.agg(F.count(col).alias("n_obs"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.max(F.abs(col)).alias("most"))
    enough = F.col("n_obs") >= 2
    flat = F.col("std") <= 1e-12 * F.greatest("most", F.lit(1.0))
    ratio: Column = F.when(enough & ~flat, F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)))
    return one.select("n_obs", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.col("std")).alias("std"), ratio.alias("icir"), (ratio * F.sqrt(F.lit(float(periods_per_year)))).alias("icir_annual"), (ratio * F.sqrt("n_obs")).alias("t_iid"))
