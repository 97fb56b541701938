"""From weights to net returns: turnover, costs, lots and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import by_name


def topk_weights(scores: DataFrame, k: int) -> DataFrame:
    """(datetime, pos, instrument, weight): equal weights of the k best scores of each date, ties by instrument; 0 for the rest."""
    place = F.row_number().over(Window.partitionBy("datetime").orderBy(F.desc_nulls_last("score"), "instrument"))
    held = F.col("score").isNotNull() & (place <= k)
    n = F.count_if(F.col("_held")).over(Window.partitionBy("datetime"))
    return scores.withColumn("_held", held).withColumn("weight", F.when(F.col("_held"), 1.0 / n).otherwise(0.0)).drop("_held")


def _change():
    return F.coalesce("weight", F.lit(0.0)) - F.coalesce(F.lag("weight").over(by_name()), F.lit(0.0))


def turnover(weights: DataFrame, *, periods_per_year: int = 252) -> DataFrame:
    """(datetime, one_side, gross, annual) of a dense grid of weights."""
    moved = weights.select("datetime", F.abs(_change()).alias("d"))
    return moved.groupBy("datetime").agg((F.sum("d") / 2).alias("one_side"), F.sum("d").alias("gross"), (F.sum("d") / 2 * periods_per_year).alias("annual"))


def trading_cost(weights: DataFrame, *, buy: float, sell: float, slippage: float = 0.0, fixed: float = 0.0) -> DataFrame:
    """(datetime, cost) as a share of the portfolio: rates on what is bought and sold, and an amount for each trade."""
    d = F.col("d")
    moved = weights.select("datetime", _change().alias("d"))
    one = F.when(d > 0, d * (buy + slippage)).when(d < 0, -d * (sell + slippage)).otherwise(0.0) + F.when(d != 0, fixed).otherwise(0.0)
    return moved.groupBy("datetime").agg(F.sum(one).alias("cost"))


def lots(targets: DataFrame, *, nav: float, lot: int = 100) -> DataFrame:
    """Adds shares: the weight's money in whole lots, rounded down; null without a positive price."""
    shares = F.floor(F.floor(F.col("weight") * nav / F.when(F.col("price") > 0, F.col("price"))) / lot) * lot
    return targets.withColumn("shares", shares.cast("bigint"))


def drawdown(returns: DataFrame, *, col: str = "ret") -> DataFrame:
    """(datetime, wealth, drawdown): compounded growth and its loss from the highest before, from 1."""
    order = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.select("datetime", F.exp(F.sum(F.log1p(F.coalesce(col, F.lit(0.0)))).over(order)).alias("wealth"))
    return grown.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(order)) - 1)


def performance(returns: DataFrame, *, col: str = "ret", periods_per_year: int = 252) -> DataFrame:
    """One row: n, mean_annual, vol_annual, sharpe, max_drawdown, calmar."""
    worst = drawdown(returns, col=col).agg(F.min("drawdown").alias("max_drawdown"))
    one = returns.agg(F.count(col).alias("n"), (F.avg(col) * periods_per_year).alias("mean_annual"), (F.stddev_samp(col) * periods_per_year**0.5).alias("vol_annual"))
    return one.crossJoin(worst).select("n", "mean_annual", "vol_annual", (F.col("mean_annual") / F.nullif(F.col("vol_annual"), F.lit(0.0))).alias("sharpe"), "max_drawdown", (F.col("mean_annual") / F.nullif(F.abs("max_drawdown"), F.lit(0.0))).alias("calmar"))


def net_returns(weights: DataFrame, *, buy: float, sell: float) -> DataFrame:
    """(datetime, gross, cost, net) of a dense grid with weight and label; a missing label earns nothing."""
    moved = weights.select("datetime", (F.col("weight") * F.coalesce("label", F.lit(0.0))).alias("g"), _change().alias("d"))
    cost = F.when(F.col("d") > 0, F.col("d") * buy).otherwise(-F.col("d") * sell)
    return moved.groupBy("datetime").agg(F.sum("g").alias("gross"), F.sum(cost).alias("cost")).withColumn("net", F.col("gross") - F.col("cost"))


def capacity_curve(weights: DataFrame, amounts: list[float], *, eta: float, periods_per_year: int = 252) -> DataFrame:
    """(amount, ir, holds): information ratio after square-root impact at each amount of money, and whether it
    is at least half of that at 0. weights: a dense grid with weight, label, sigma and adv (daily money traded).

    Impact is proportional to the root of the amount, so each date has one coefficient, whatever the grid of amounts.
    """
    d = F.abs(F.col("d"))
    moved = weights.select("datetime", "sigma", "adv", (F.col("weight") * F.coalesce("label", F.lit(0.0))).alias("g"), _change().alias("d"))
    impact = F.coalesce(d * eta * F.col("sigma") * F.sqrt(d / F.when(F.col("adv") > 0, F.col("adv"))), F.lit(0.0))
    dates = moved.groupBy("datetime").agg(F.sum("g").alias("gross"), F.sum(impact).alias("k"))
    each = dates.withColumn("amount", F.explode(F.array(*[F.lit(float(a)) for a in sorted({0.0, *amounts})])))
    net = F.col("gross") - F.sqrt("amount") * F.col("k")
    curve = each.groupBy("amount").agg((F.avg(net) / F.nullif(F.stddev_samp(net), F.lit(0.0)) * periods_per_year**0.5).alias("ir"))
    return curve.withColumn("holds", F.col("ir") >= 0.5 * F.max(F.when(F.col("amount") == 0, F.col("ir"))).over(Window.partitionBy()))
