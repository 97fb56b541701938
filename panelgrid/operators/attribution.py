"""Where a portfolio's active return comes from, and whether a study meets its bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hac import newey_west

#: Contributions are added up as decimals, so the parts of a total are that total, in whatever order tasks add.
#: Sums have room for the digits that a difference of two may need.
_EXACT, _SUM, _DIFFERENCE = "decimal(24,14)", "decimal(34,14)", "decimal(36,14)"

#: Criteria in order, the figure that each looks at, and its bound.
GATES = (
    ("AC-1", "mean_ic", ">=", 0.025),
    ("AC-2", "t_nw", ">=", 2.5),
    ("AC-3", "icir_ann", ">=", 0.35),
    ("AC-4", "p_mono", "<=", 0.05),
    ("AC-5", "t_spread_net", ">=", 2.0),
    ("AC-6", "p_dsr", "<=", 0.05),
    ("AC-7", "turnover_annual", "<=", 12.0),
    ("AC-8", "leakage_clean", ">=", 1.0),
)


def contributions(weights: DataFrame, groups: DataFrame, levels: Sequence[str], *, buy: float = 0.0, sell: float = 0.0) -> DataFrame:
    """(datetime, level, levels..., n, gross, cost, net, benchmark, active) at each level of a hierarchy, from the total (level 0) to
    its finest groups (level len(levels)); the groups above a row's level are null below it.

    weights: a dense grid (datetime, pos, instrument, weight, label). groups: (instrument, levels...), the coarsest first; what has no
    group is "unassigned". The benchmark holds equal weights of all instruments with a label. Active is net less benchmark. All
    levels come from one pass over the grid, and each level adds up to the one above it exactly.
    """
    moved = F.coalesce("weight", F.lit(0.0)) - F.coalesce(F.lag("weight").over(Window.partitionBy("instrument").orderBy("pos")), F.lit(0.0))
    rows = weights.select("datetime", "instrument", "label", F.coalesce("weight", F.lit(0.0)).alias("w"), moved.alias("d"))
    counted = rows.join(rows.groupBy("datetime").agg(F.count("label").alias("_n")), "datetime")
    one = {
        "gross": F.col("w") * F.coalesce("label", F.lit(0.0)),
        "cost": F.when(F.col("d") > 0, F.col("d") * buy).otherwise(-F.col("d") * sell),
        "benchmark": F.coalesce(F.try_divide(F.col("label"), F.col("_n")), F.lit(0.0)),
    }
    placed = counted.join(groups.select("instrument", *levels), "instrument", "left").fillna("unassigned", list(levels))
    exact = placed.select("datetime", *levels, *[v.cast(_EXACT).alias(k) for k, v in one.items()])
    sets = [["datetime", *levels[:k]] for k in range(len(levels) + 1)]
    sums = exact.groupingSets([[F.col(c) for c in s] for s in sets], "datetime", *levels).agg(
        sum((1 - F.grouping(c) for c in levels), F.lit(0)).cast("int").alias("level"), F.count(F.lit(1)).alias("n"), *[F.sum(k).cast(_SUM).alias(k) for k in one]
    )
    net = F.col("gross") - F.col("cost")
    return sums.select("datetime", "level", *levels, "n", "gross", "cost", net.cast(_DIFFERENCE).alias("net"), "benchmark", (net - F.col("benchmark")).cast(_DIFFERENCE).alias("active"))


def attribution(parts: DataFrame, levels: Sequence[str], *, col: str = "active", p_value: bool = True) -> DataFrame:
    """(level, levels..., n_obs, mean, standard_error, t_stat, p_value): the mean of each group's contributions over dates, with its
    Newey-West test. parts: what contributions returns."""
    tested = newey_west(parts.withColumn(col, F.col(col).cast("double")), col=col, by=["level", *levels], p_value=p_value)
    return tested.select("level", *levels, "n_obs", "mean", "standard_error", "t_stat", "p_value")


def evaluate_gates(figures: DataFrame) -> DataFrame:
    """(criterion, figure, value, bound, rule, status) in order for one row of figures: pass or fail, or not_evaluated where the figure is
    missing or undefined."""
    known = set(figures.columns)
    value = lambda name: F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) if name in known else F.lit(None).cast("double")
    rows = F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(name).alias("figure"), value(name).alias("value"), F.lit(float(bound)).alias("bound"), F.lit(rule).alias("rule")) for c, name, rule, bound in GATES])
    one = figures.select(F.explode(rows).alias("g")).select("g.*")
    met = F.when(F.col("rule") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return one.withColumn("status", F.when(F.col("value").isNull(), "not_evaluated").when(met, "pass").otherwise("fail"))


def accepted(gates: DataFrame) -> DataFrame:
    """One row: n_pass, n_fail, n_not_evaluated, and accepted: all criteria pass."""
    count = lambda s: F.count_if(F.col("status") == s)
    return gates.agg(count("pass").alias("n_pass"), count("fail").alias("n_fail"), count("not_evaluated").alias("n_not_evaluated")).withColumn("accepted", (F.col("n_fail") == 0) & (F.col("n_not_evaluated") == 0))
