"""Inference on the mean of a per-date series that is autocorrelated.

The series has one row per date, so it is gathered into one array; lags are then array expressions,
and the whole test is one row of one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.tails import normal_quantile, p_normal, p_student, student_quantile

RHO_BOUND = 0.99


def automatic_bandwidth(n: Column) -> Column:
    return F.least(F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))), n - 1).cast("bigint")


def _series(df: DataFrame, col: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each of by): n, mean, u (centred values in order). Nulls are gone before lags are formed."""
    kept = df.where(F.col(col).isNotNull()).select(*by, F.struct(order, col).alias("s"))
    one = kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s[col].cast("double")).alias("x"))
    one = one.withColumn("n", F.size("x").cast("bigint")).withColumn("rough", F.when(F.col("n") > 0, F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / F.col("n")))
    # a second pass takes the rounding out of the mean, so that a constant series has no variance
    one = one.withColumn("mean", F.when(F.col("n") > 0, F.col("rough") + F.aggregate("x", F.lit(0.0), lambda a, b: a + (b - F.col("rough"))) / F.col("n")))
    return one.select(*by, "n", "mean", F.transform("x", lambda v: v - F.col("mean")).alias("u"))


def _lagged(u: Column, lag: Column) -> Column:
    """Sum of u[t] * u[t - lag]."""
    later, earlier = F.slice(u, (lag + 1).cast("int"), F.size(u)), F.slice(u, F.lit(1), (F.size(u) - lag).cast("int"))
    return F.aggregate(F.zip_with(later, earlier, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def autocovariances(df: DataFrame, lags: int, *, col: str = "ic", order: str = "datetime") -> DataFrame:
    """(lag, gamma) for lags 0 to lags, each divided by the length of the series."""
    one = _series(df, col, order)
    return one.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "u", "n").select("lag", (_lagged(F.col("u"), F.col("lag")) / F.col("n")).alias("gamma"))


def _long_run(u: str, n: str, bandwidth: str) -> Column:
    gamma = lambda lag: _lagged(F.col(u), lag) / F.col(n)
    tail = F.transform(F.when(F.col(bandwidth) >= 1, F.sequence(F.lit(1).cast("bigint"), F.col(bandwidth))).otherwise(F.array().cast("array<bigint>")), lambda lag: (1 - lag / (F.col(bandwidth) + 1.0)) * gamma(lag))
    return gamma(F.lit(0)) + 2 * F.aggregate(tail, F.lit(0.0), lambda s, x: s + x)


def ar1(df: DataFrame, *, col: str = "ic", order: str = "datetime") -> DataFrame:
    """One row: n, rho: sum of products with the value before over the sum of its squares, within +-RHO_BOUND."""
    return _series(df, col, order).select("n", _rho(F.col("u")).alias("rho"))


def _rho(u: Column) -> Column:
    past = F.slice(u, F.lit(1), F.size(u) - 1)
    rho = _lagged(u, F.lit(1)) / F.nullif(F.aggregate(past, F.lit(0.0), lambda s, x: s + x * x), F.lit(0.0))
    return F.when(F.size(u) > 1, F.when(rho.isNotNull(), F.greatest(F.lit(-RHO_BOUND), F.least(F.lit(RHO_BOUND), rho))).otherwise(0.0))


def lag1_autocorrelation(df: DataFrame, *, col: str = "ic", order: str = "datetime") -> DataFrame:
    """One row: n, acf1 over the full-sample variance; null under three values or without variance."""
    u = F.col("u")
    return _series(df, col, order).select("n", F.when(F.col("n") >= 3, _lagged(u, F.lit(1)) / F.nullif(_lagged(u, F.lit(0)), F.lit(0.0))).alias("acf1"))


def newey_west(df: DataFrame, *, col: str = "ic", order: str = "datetime", bandwidth: int | None = None, least_bandwidth: int = 0, correct: bool = True, k_reg: int | None = None, reference: str = "normal", prewhiten: bool = False, min_obs: int = 3, p_value: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each of by, the columns that tell series apart): n_obs, mean, variance, standard_error, t_stat, p_value, bandwidth, degrees_of_freedom,
    k_reg, correction_factor, ar1_coefficient, bandwidth_is_automatic, reference, small_sample_correction,
    prewhiten. An automatic bandwidth is least_bandwidth at least, as far as the series is longer. Fewer than min_obs
    values give nulls and bandwidth 0; no more than k_reg are an error."""
    if reference not in ("normal", "student"):
        raise ValueError(f"unknown reference {reference!r}")
    if min_obs < 3 or (bandwidth is not None and bandwidth < 0) or (k_reg is not None and k_reg < 1):
        raise ValueError("min_obs has to be 3, bandwidth 0 and k_reg 1 at least")
    one = _series(df, col, order, by).withColumn("n_all", F.col("n"))
    if prewhiten:
        one = one.withColumn("rho", _rho(F.col("u")))
        e = F.zip_with(F.slice("u", F.lit(2), F.greatest(F.size("u") - 1, F.lit(0))), F.slice("u", F.lit(1), F.greatest(F.size("u") - 1, F.lit(0))), lambda a, b: a - F.col("rho") * b)
        one = one.withColumn("e", e).withColumn("n", F.size("e").cast("bigint"))
        level = F.aggregate("e", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.col("n").cast("double"), F.lit(0.0))
        one = one.withColumn("level", level).withColumn("u", F.transform("e", lambda x: x - F.col("level")))
    else:
        one = one.withColumn("rho", F.lit(None).cast("double"))
    k = F.lit(k_reg if k_reg is not None else 1 + (bandwidth is None)).cast("bigint")
    enough = F.col("n_all") >= min_obs
    few = F.when(enough & (F.col("n") <= k), F.raise_error(F.lit("k_reg has to be less than the number of values")))
    if bandwidth is None:
        one = one.withColumn("bw", F.coalesce(few.cast("bigint"), F.when(enough, F.least(F.greatest(automatic_bandwidth(F.col("n")), F.lit(least_bandwidth)), F.col("n") - 1)).otherwise(F.lit(0)).cast("bigint")))
    else:
        wide = F.when(enough & (F.lit(bandwidth) > F.col("n") - 1), F.raise_error(F.lit("the bandwidth has to be shorter than the series")))
        one = one.withColumn("bw", F.coalesce(few.cast("bigint"), wide.cast("bigint"), F.when(enough, F.lit(bandwidth)).otherwise(F.lit(0)).cast("bigint")))
    one = one.withColumn("variance", F.when(enough, _long_run("u", "n", "bw") / F.coalesce(F.pow(1 - F.col("rho"), F.lit(2.0)), F.lit(1.0))))
    factor = F.sqrt(F.col("n") / (F.col("n") - k).cast("double")) if correct else F.lit(1.0)
    one = one.withColumn("factor", F.when(enough, factor))
    one = one.withColumn("se", F.when(F.col("variance") > 0, F.sqrt(F.col("variance") / F.col("n")) * F.col("factor")))
    one = one.withColumn("t", F.col("mean") / F.nullif(F.col("se"), F.lit(0.0)))
    one = one.withColumn("df", F.when(enough, (F.col("n") - 1).cast("double")))
    p = (p_normal("t") if reference == "normal" else p_student("t", "df")) if p_value else F.lit(None).cast("double")
    return one.select(
        *by, F.when(enough, F.col("n")).otherwise(F.col("n_all")).alias("n_obs"), "mean", "variance", F.col("se").alias("standard_error"), F.col("t").alias("t_stat"), p.alias("p_value"),
        F.col("bw").alias("bandwidth"), F.col("df").alias("degrees_of_freedom"), F.when(enough, k).otherwise(F.lit(k_reg or 1)).cast("bigint").alias("k_reg"), F.col("factor").alias("correction_factor"), F.when(enough, F.col("rho")).alias("ar1_coefficient"),
        F.lit(bandwidth is None).alias("bandwidth_is_automatic"), F.lit(reference).alias("reference"), F.lit(correct).alias("small_sample_correction"), F.lit(prewhiten).alias("prewhiten"),
    )


def both_references(df: DataFrame, **kwargs) -> DataFrame:
    """Two records of newey_west, which differ in their reference and p-value; the series is gathered once."""
    record = newey_west(df, p_value=False, **kwargs)
    each = record.withColumn("reference", F.explode(F.array(F.lit("normal"), F.lit("student"))))
    p = F.when(F.col("reference") == "student", p_student("t_stat", "degrees_of_freedom")).otherwise(p_normal("t_stat"))
    return each.withColumn("p_value", p).select(*record.columns)


def confidence_interval(record: DataFrame, *, level: float = 0.95) -> DataFrame:
    """Adds ci_low and ci_high to records of newey_west: mean -+ quantile * standard error, by each record's own
    reference. A quantile is found once for each reference and number of degrees of freedom, and joined."""
    if not 0 < level < 1:
        raise ValueError("the level has to lie between 0 and 1")
    upper = F.lit((1 + level) / 2)
    key = lambda c: F.when(F.col("reference") == "student", F.col(c)).otherwise(0.0)
    record = record.withColumn("_df", F.coalesce(key("degrees_of_freedom"), F.lit(-1.0)))
    wanted = record.select(F.col("reference").alias("_ref"), "_df").distinct()
    found = wanted.withColumn("_q", F.when(F.col("_ref") == "student", student_quantile(upper, F.when(F.col("_df") > 0, F.col("_df")))).otherwise(normal_quantile(upper)))
    both = record.join(found, (record["reference"] == found["_ref"]) & (record["_df"] == found["_df"]), "left").drop(found["_df"])
    half = F.col("_q") * F.col("standard_error")
    return both.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half}).drop("_df", "_ref", "_q")


def ic_summary(series: DataFrame, *, col: str = "ic", order: str = "datetime", periods_per_year: int = 252, level: float = 0.95, reference: str = "normal") -> DataFrame:
    """One row: n_periods, mean, std, icir, icir_ann, t_nw, p_nw, nw_bandwidth, ci_low and ci_high of a series of ICs."""
    from .ic import moments

    tested = confidence_interval(newey_west(series, col=col, order=order, reference=reference), level=level)
    one = moments(series, col=col, periods_per_year=periods_per_year).select("n_obs", "std", "icir", "icir_annual")
    return one.crossJoin(F.broadcast(tested.drop("n_obs"))).select(F.col("n_obs").alias("n_periods"), "mean", "std", "icir", F.col("icir_annual").alias("icir_ann"), F.col("t_stat").alias("t_nw"), F.col("p_value").alias("p_nw"), F.col("bandwidth").alias("nw_bandwidth"), "ci_low", "ci_high")
