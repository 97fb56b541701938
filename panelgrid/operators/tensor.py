"""Look-back windows as array columns, with masks instead of dropped rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import by_name, finite

COMPONENTS = ("label_available", "provided_mask", "tradable_on_decision_date", "enough_valid_steps")


def window_array(grid: DataFrame, cols: Sequence[str], out: str, lookback: int) -> DataFrame:
    """Array of the last ``lookback`` rows, each an array of cols; null rows stand before the first date."""
    w = by_name().rowsBetween(-(lookback - 1), 0)
    steps = F.collect_list(F.struct(F.array(*[finite(F.col(c).cast("double")) for c in cols]).alias("v"))).over(w)
    pad = F.array_repeat(F.array(*[F.lit(None).cast("double") for _ in cols]), F.lit(lookback) - F.size(steps))
    return grid.withColumn(out, F.concat(pad, F.transform(steps, lambda s: s.v)))


def sequence_bundle(grid: DataFrame, features: Sequence[str], label: str, *, lookback: int, fill: float = 0.0, provided: str | None = None, tradable: str | None = None, weight: str | None = None, min_valid_steps: int = 1, neutralize: bool = True) -> DataFrame:
    """One row per cell of the grid: datetime, instrument, X (lookback x features, sorted by name),
    step_mask, y, weight, mask, components. A step is valid if all its features are; others are filled."""
    names = sorted(features)
    rows = window_array(grid, names, "_w", lookback)
    valid = F.transform("_w", lambda s: F.forall(s, lambda v: v.isNotNull()))
    open_ = F.coalesce(F.col(tradable), F.lit(False)) if tradable else F.lit(True)
    rows = rows.withColumn("_valid", valid).withColumn("_open", open_)
    last = lambda i: i == lookback - 1
    steps = F.transform("_valid", lambda v, i: v & (F.col("_open") | ~last(i))) if neutralize else F.col("_valid")
    rows = rows.withColumn("step_mask", steps)
    x = F.zip_with("_w", "step_mask", lambda s, ok: F.transform(s, lambda v: F.when(ok, v).otherwise(F.lit(fill)).cast("float")))
    y = finite(F.col(label).cast("double"))
    given = F.coalesce(F.col(provided).cast("double") > 0.5, F.lit(False)) if provided else F.lit(True)
    enough = F.size(F.filter("step_mask", lambda ok: ok)) >= min_valid_steps
    rows = rows.withColumn("components", F.struct(y.isNotNull().alias(COMPONENTS[0]), given.alias(COMPONENTS[1]), F.col("_open").alias(COMPONENTS[2]), enough.alias(COMPONENTS[3])))
    mask: Column = F.lit(True)
    for c in COMPONENTS:
        mask = mask & F.col(f"components.{c}")
    w = F.coalesce(finite(F.col(weight).cast("double")), F.lit(0.0)) if weight else F.lit(1.0)
    return rows.select("datetime", "instrument", x.alias("X"), "step_mask", y.cast("float").alias("y"), w.cast("float").alias("weight"), mask.alias("mask"), "components")


def select_component(bundle: DataFrame, name: str) -> DataFrame:
    if name not in COMPONENTS:
        raise KeyError(f"unknown component {name!r}; known: {', '.join(COMPONENTS)}")
    return bundle.select("datetime", "instrument", F.col(f"components.{name}").alias(name))


def describe(bundle: DataFrame, *, fill: float = 0.0) -> DataFrame:
    """One row of diagnostics. fill: what the bundle was filled with."""
    n_valid = F.count_if("mask")
    invalid = [F.count_if(~F.col(f"components.{c}")).alias(f"invalid_by_{c}") for c in COMPONENTS]
    return bundle.agg(F.count(F.lit(1)).alias("n_samples"), n_valid.alias("n_valid"), F.round(F.avg(F.col("mask").cast("double")), 6).alias("coverage"), F.max(F.size("X")).alias("lookback"), F.max(F.size(F.element_at("X", 1))).alias("n_features"), F.round(F.avg(F.size(F.filter("step_mask", lambda ok: ok))), 3).alias("mean_valid_steps"), F.lit(float(fill)).alias("fill_value"), *invalid)


def masked_mean(df: DataFrame, value: str, mask: str, weight: str | None = None, out: str = "masked_mean") -> DataFrame:
    """One row: weighted mean over masked rows; a missing value adds nothing but its weight counts. Null without weight."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    on = F.coalesce(F.col(mask), F.lit(False))
    total = F.sum(F.when(on, w))
    return df.agg(F.when(total > 0, F.coalesce(F.sum(F.when(on, finite(F.col(value).cast("double")) * w)), F.lit(0.0)) / F.nullif(total, F.lit(0.0))).alias(out))


def flatten_last_step(bundle: DataFrame, names: Sequence[str], fill: float = 0.0) -> DataFrame:
    """The last step's features as columns, missing ones filled."""
    return bundle.select("datetime", "instrument", *[F.coalesce(F.element_at(F.element_at("X", -1), i + 1).cast("double"), F.lit(fill)).alias(n) for i, n in enumerate(sorted(names))])
