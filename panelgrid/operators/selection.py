"""Over-fitting and order: symmetric cross-validation, and the monotonicity bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import REPLICATES, indices


def cscv(trials: DataFrame, groups: int = 16) -> DataFrame:
    """(split, best, oos, median): for each half of the groups of dates, given as bits, the trial of the
    largest mean in it (ties: the least name), its mean in the other half, and the trials' median there.

    trials: (datetime, trial, ret). Dates are dealt into groups in order. Each trial becomes one row
    of group sums, so the splits cost no further pass over dates.
    """
    if groups % 2 or not 2 <= groups <= 20:
        raise ValueError("an even number of groups, 20 at most")
    full = trials.where("ret is not null")
    days = full.select("datetime").distinct().withColumn("_k", F.row_number().over(Window.orderBy("datetime")) - 1)
    days = days.withColumn("_g", F.floor(F.col("_k") * groups / F.count(F.lit(1)).over(Window.partitionBy())).cast("int"))
    in_group = lambda v: F.array(*[F.coalesce(F.sum(F.when(F.col("_g") == g, v)), F.lit(0.0)) for g in range(groups)])
    sums = full.join(days, "datetime").groupBy("trial").agg(in_group(F.col("ret")).alias("s"), in_group(F.lit(1.0)).alias("n"))
    masks = F.filter(F.sequence(F.lit(0), F.lit(2**groups - 1)), lambda m: F.bit_count(m) == groups // 2)
    inside = lambda c, bit: F.aggregate(F.sequence(F.lit(0), F.lit(groups - 1)), F.lit(0.0), lambda t, g: t + F.when(F.getbit(F.col("split"), g) == bit, F.get(c, g)).otherwise(0.0))
    each = sums.withColumn("split", F.explode(masks)).select("split", "trial", F.try_divide(inside("s", 1), inside("n", 1)).alias("ins"), F.try_divide(inside("s", 0), inside("n", 0)).alias("oos")).where("ins is not null and oos is not null")
    order = Window.partitionBy("split").orderBy(F.desc("ins"), "trial")
    ranked = each.withColumn("_r", F.row_number().over(order)).withColumn("median", F.median("oos").over(Window.partitionBy("split")))
    return ranked.where("_r = 1").select("split", F.col("trial").alias("best"), "oos", "median")


def pbo(trials: DataFrame, groups: int = 16) -> DataFrame:
    """One row (n_splits, pbo): how often the best trial of one half is below the median in the other."""
    return cscv(trials, groups).agg(F.count(F.lit(1)).alias("n_splits"), F.avg((F.col("oos") < F.col("median")).cast("double")).alias("pbo"))


def _spearman(means: Column, q: int) -> Column:
    """Rank correlation of bucket numbers and their means, ties sharing the mean of their ranks; null if all means are equal."""
    ranks = F.transform(means, lambda v: F.size(F.filter(means, lambda o: o < v)) + (F.size(F.filter(means, lambda o: o == v)) + 1) / 2.0)
    centred = lambda c: F.transform(c, lambda v: v - (q + 1) / 2.0)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    x, y = centred(F.array(*[F.lit(float(k)) for k in range(1, q + 1)])), centred(ranks)
    return F.try_divide(dot(x, y), F.nullif(F.sqrt(dot(x, x) * dot(y, y)), F.lit(0.0)))


def monotonicity(buckets: DataFrame, q: int, *, replicates: int = REPLICATES, mean_block: float = 1.0, seed: int = 0, method: str = "stationary", level: float = 0.05) -> DataFrame:
    """One row: n, gap (least step between adjacent bucket means), p_mono (share of recentred replicates
    whose gap is at least that), spread of the top and bottom buckets with its interval, and the rank
    correlation of bucket and mean with its interval; no row without a date that has all buckets.

    buckets: (datetime, bucket, ret); dates without all of them are left out. Replicates draw dates as
    bootstrap.indices does, alike for all buckets. The dates' returns are broadcast, bounded by the calendar.
    """
    days = buckets.groupBy("datetime").agg(*[F.max(F.when(F.col("bucket") == k, F.col("ret"))).alias(f"_{k}") for k in range(1, q + 1)]).dropna()
    values = days.select((F.row_number().over(Window.orderBy("datetime")) - 1).cast("bigint").alias("i"), *[f"_{k}" for k in range(1, q + 1)])
    mean_of = F.array(*[F.avg(f"_{k}") for k in range(1, q + 1)])
    gap_of = lambda m: F.array_min(F.transform(F.sequence(F.lit(1), F.lit(q - 1)), lambda k: F.get(m, k) - F.get(m, k - 1)))
    spread_of = lambda m: F.get(m, F.lit(q - 1)) - F.get(m, F.lit(0))
    observed = values.agg(F.count(F.lit(1)).alias("n"), mean_of.alias("m")).where("n > 0")
    drawn = indices(observed.select("n"), method=method, replicates=replicates, mean_block=mean_block, seed=seed)
    each = drawn.drop("n").join(F.broadcast(values), "i").groupBy("b").agg(mean_of.alias("_m")).crossJoin(F.broadcast(observed))  # one row
    moved = F.zip_with("_m", "m", lambda a, b: a - b)
    ends = F.array(F.lit(level / 2), F.lit(1 - level / 2))
    out = each.groupBy("n", "m").agg(
        F.avg((gap_of(moved) >= gap_of(F.col("m"))).cast("double")).alias("p_mono"), F.percentile(spread_of(F.col("_m")), ends).alias("_s"), F.percentile(_spearman(F.col("_m"), q), ends).alias("_r")
    )
    at = lambda c, k: F.get(c, F.lit(k))
    return out.select("n", gap_of(F.col("m")).alias("gap"), "p_mono", spread_of(F.col("m")).alias("spread"), at("_s", 0).alias("spread_lo"), at("_s", 1).alias("spread_hi"), _spearman(F.col("m"), q).alias("spearman"), at("_r", 0).alias("spearman_lo"), at("_r", 1).alias("spearman_hi"))


def trial_moments(trials: DataFrame) -> DataFrame:
    """(trial, n, sharpe, skew, kurt): Sharpe ratio of a period, and population skewness and kurtosis (3 for a normal)."""
    return trials.groupBy("trial").agg(F.count("ret").alias("n"), F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sharpe"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))


def effective_trials(trials: DataFrame, *, redundant: float = 0.95) -> DataFrame:
    """One row (m, k_eff): the trials, less those that correlate with an earlier one (by name) at ``redundant`` or more over common dates."""
    side = lambda k: trials.where("ret is not null").select("datetime", F.col("trial").alias(k), F.col("ret").alias(f"r_{k}"))
    alike = side("a").join(side("b"), "datetime").where("a < b").groupBy("a", "b").agg(F.corr("r_a", "r_b").alias("rho")).where((F.col("rho") >= redundant) & ~F.isnan("rho"))
    counts = trials.agg(F.count_distinct("trial").alias("m")).crossJoin(F.broadcast(alike.agg(F.count_distinct("b").alias("_same"))))  # one row each
    return counts.select("m", (F.col("m") - F.col("_same")).alias("k_eff"))


def deflated_sharpe(trials: DataFrame, *, redundant: float = 0.95) -> DataFrame:
    """One row of the trial with the largest Sharpe ratio: trial, n, sharpe, k_eff, sharpe_star (the largest
    that k_eff trials would show by chance), dsr and p_dsr = 1 - dsr."""
    from panelgrid.functions.tails import normal_cdf, normal_quantile

    each = trial_moments(trials).where("sharpe is not null")
    best = each.agg(F.max_by(F.struct("trial", "n", "sharpe", "skew", "kurt"), F.struct("sharpe", "trial")).alias("x"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("v"))
    one = best.select("x.*", "v").crossJoin(F.broadcast(effective_trials(trials, redundant=redundant)))  # one row each
    euler = 0.5772156649015329
    k = F.greatest(F.col("k_eff").cast("double"), F.lit(1.0))
    star = F.when(k > 1, F.col("v") * ((1 - euler) * normal_quantile(1 - 1 / k) + euler * normal_quantile(1 - 1 / (k * F.lit(2.718281828459045))))).otherwise(0.0)
    one = one.withColumn("sharpe_star", star)
    spread = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    one = one.withColumn("dsr", normal_cdf((F.col("sharpe") - F.col("sharpe_star")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(spread > 0, spread))))
    return one.select("trial", "n", "sharpe", "k_eff", "sharpe_star", "dsr", (1 - F.col("dsr")).alias("p_dsr"))


def monotonicity_studentized(buckets: DataFrame, q: int, *, replicates: int, block: int, seed: int, level: float = 0.05) -> DataFrame:
    """One row: n, t_gap (least step between adjacent bucket means over the Newey-West standard error of that step),
    p_mono (share of replicates, recentred and studentized by their own errors, that reach it), and each mean's interval as lo and hi.

    buckets: (datetime, bucket, ret); dates without all of them are left out. The driver holds one mean for each date and
    bucket, bounded by the calendar; replicates are dealt to tasks, each with a generator of its own.
    """
    import numpy as np

    spark = buckets.sparkSession
    days = buckets.groupBy("datetime").agg(*[F.max(F.when(F.col("bucket") == k, F.col("ret"))).alias(f"_{k}") for k in range(1, q + 1)]).dropna().orderBy("datetime")
    x = np.array([r[1:] for r in days.collect()], float).reshape(-1, q)
    n = len(x)
    schema = "n bigint, t_gap double, p_mono double, lo array<double>, hi array<double>"
    if n < 3:
        return spark.createDataFrame([(n, None, None, None, None)], schema)
    width, mean = min(int(4 * (n / 100) ** (2 / 9)), n - 1), x.mean(0)

    def student(rows, centre):
        steps = np.diff(rows, axis=1)
        gaps = steps.mean(0) - np.diff(centre)
        u = steps[:, gaps.argmin()]
        u = u - u.mean()
        v = sum((1 if k == 0 else 2) * (1 - k / (width + 1)) * float(u[k:] @ u[: n - k]) / n for k in range(width + 1))
        return gaps.min() / np.sqrt(v / n) if v > 0 else np.nan

    def run(batches):
        import pandas as pd

        for b in batches:
            made = []
            for i in b["id"]:
                starts = np.random.default_rng([seed, int(i)]).integers(0, n, -(-n // block))
                drawn = x[((starts[:, None] + np.arange(block)).ravel()[:n]) % n]
                made.append((student(drawn, mean), drawn.mean(0).tolist()))
            yield pd.DataFrame(made, columns=["t", "m"])

    observed = float(student(x, np.zeros(q)))
    each = spark.range(replicates).mapInPandas(run, "t double, m array<double>")
    reached = F.avg(F.when(~F.isnan("t"), (F.col("t") >= observed).cast("double")))
    ends = lambda p: F.array(*[F.percentile(F.get("m", F.lit(k)), p) for k in range(q)])
    undefined = observed != observed
    return each.agg(F.lit(n).cast("bigint").alias("n"), F.lit(None if undefined else observed).cast("double").alias("t_gap"), (F.lit(None).cast("double") if undefined else reached).alias("p_mono"), ends(level / 2).alias("lo"), ends(1 - level / 2).alias("hi"))
