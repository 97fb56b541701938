"""Resampling of a per-date series that keeps its serial dependence.

Draws come from a hash of seed, replicate and place, so a replicate is the same however it is dealt to tasks.
Indices of all replicates are found by one running window over (replicate, place), dealt by replicate before places are
made, so that the window needs no shuffle. A series has one row per date: its values are broadcast, bounded by the
calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Registered methods and their number of replicates.
METHODS = ("stationary", "circular_block", "iid")
REPLICATES = 10_000
_DIGITS = 12  # hexadecimal digits of a draw


def _draw(name: str, seed: int, first: int) -> Column:
    """A whole number below 16 ** _DIGITS from part of the digest of (seed, b, name)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("b").cast("string"), F.col(name).cast("string"))), first, _DIGITS), 16, 10).cast("bigint")


def numbered(series: DataFrame, col: str, order: str = "datetime") -> DataFrame:
    """(t, n, x): the values that aren't null in order, from 0, with their number. One task numbers a calendar's rows."""
    kept = series.where(F.col(col).isNotNull())
    t = F.row_number().over(Window.orderBy(order)) - 1
    return kept.select(t.cast("bigint").alias("t"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"), F.col(col).cast("double").alias("x"))


def indices(length: DataFrame, *, method: str = "stationary", replicates: int = REPLICATES, mean_block: float = 1.0, seed: int = 0) -> DataFrame:
    """(b, t, n, i): place t of replicate b takes value i. length: one row (n).

    stationary begins a new block at each place with the chance 1 / mean_block (and at the first), circular_block after every
    mean_block places (rounded up); blocks begin anywhere and run on around the end. iid draws each place alone.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    if replicates < 1 or mean_block < 1:
        raise ValueError("one replicate and blocks of one value at least")
    ids = length.sparkSession.range(replicates).select(F.col("id").alias("b")).repartition("b")
    places = ids.crossJoin(F.broadcast(length.select("n"))).where("n > 0").select("b", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("t"))
    if method == "iid":
        return places.select("b", "t", "n", (_draw("t", seed, 1) % F.col("n")).alias("i"))
    if method == "circular_block":
        block = int(-(-mean_block // 1))
        placed = places.withColumn("_k", F.floor(F.col("t") / block))
        return placed.select("b", "t", "n", ((_draw("_k", seed, 1) + F.col("t") % block) % F.col("n")).alias("i"))
    begins = (F.col("t") == 0) | (_draw("t", seed, 1 + _DIGITS) < F.lit(int(16**_DIGITS / mean_block)))
    marked = places.withColumn("_from", F.when(begins, F.struct(F.col("t").alias("at"), (_draw("t", seed, 1) % F.col("n")).alias("start"))))
    running = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.withColumn("_last", F.last("_from", ignorenulls=True).over(running))
    return found.select("b", "t", "n", ((F.col("_last.start") + F.col("t") - F.col("_last.at")) % F.col("n")).alias("i"))


def means(series: DataFrame, *, col: str, order: str = "datetime", **kwargs) -> DataFrame:
    """(b, mean) of every replicate; the arguments are those of indices. A series without values has no replicate."""
    values = numbered(series, col, order)
    drawn = indices(values.agg(F.max("n").alias("n")), **kwargs)
    return drawn.join(F.broadcast(values.select(F.col("t").alias("i"), "x")), "i").groupBy("b").agg(F.avg("x").alias("mean"))


def summary(series: DataFrame, *, col: str, order: str = "datetime", level: float = 0.05, **kwargs) -> DataFrame:
    """One row: n, replicates, mean, se (of the replicates' means), lo and hi (percentiles), p_value: two-sided, the
    share of replicates whose recentred mean lies as far from zero as the mean."""
    values = numbered(series, col, order)
    observed = values.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("observed"))
    each = means(series, col=col, order=order, **kwargs).crossJoin(F.broadcast(observed))
    far = (F.abs(F.col("mean") - F.col("observed")) >= F.abs("observed")).cast("double")
    ends = F.percentile("mean", F.array(F.lit(level / 2), F.lit(1 - level / 2)))
    one = each.groupBy("n", "observed").agg(F.count(F.lit(1)).alias("replicates"), F.stddev_samp("mean").alias("se"), ends.alias("_e"), F.avg(far).alias("p_value"))
    return one.select("n", "replicates", F.col("observed").alias("mean"), "se", F.get("_e", F.lit(0)).alias("lo"), F.get("_e", F.lit(1)).alias("hi"), "p_value")
