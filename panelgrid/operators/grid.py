"""Panels: long tables keyed by (datetime, instrument), and the dense grid that row frames need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["datetime", "instrument"]

#: Rows that a task sorts on average, of some 100 bytes each.
TASK_ROWS = 1_000_000


def by_date():
    """Window of a cross-section."""
    return Window.partitionBy("datetime")


def by_name():
    """Window of an instrument in time."""
    return Window.partitionBy("instrument").orderBy("pos")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in partitions of TASK_ROWS rows on average, so that a task's memory doesn't grow with the input: adaptive execution merges
    partitions by their compressed bytes, and sorted rows take ten times as many. Few rows are left to the session."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def finite(c: Column) -> Column:
    """NaN and infinities become null: the engine knows no other missing value."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ingress(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce value columns to double, what can't be read and what isn't finite to null."""
    require_columns(df, columns)
    return df.withColumns({c: finite(F.expr(f"try_cast(`{c}` AS DOUBLE)")) for c in columns})


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df, after a check that names up to three repeated keys."""
    if found := duplicate_keys(df, keys).orderBy(*keys).limit(3).collect():
        raise ValueError("duplicate keys: " + "; ".join(", ".join(str(r[k]) for k in keys) for r in found))
    return df


def calendar(df: DataFrame) -> DataFrame:
    """(datetime, pos): the distinct dates numbered from 0. A calendar has thousands of rows at most, so one task may number it."""
    days = df.select("datetime").where("datetime is not null").distinct()
    return days.withColumn("pos", (F.row_number().over(Window.orderBy("datetime")) - 1).cast("bigint"))


def fixed(days: DataFrame) -> tuple[DataFrame, int]:
    """A calendar and its length; it comes to the driver once, so that what it is made from isn't read again by each job."""
    rows = days.toArrow()
    return days.sparkSession.createDataFrame(rows, days.schema), rows.num_rows


def instruments(df: DataFrame) -> int:
    """Their number."""
    return df.select("instrument").where("instrument is not null").distinct().count()


def densify(df: DataFrame, columns: Sequence[str], *, days: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Every date with every instrument; missing cells are null. days: (datetime, pos); names: (instrument)."""
    require_columns(df, [*KEYS, *columns])
    days = calendar(df) if days is None else days
    names = df.select("instrument").where("instrument is not null").distinct() if names is None else names
    # the calendar is the small side, by nature: each instrument is repeated for each date
    cells = names.crossJoin(F.broadcast(days))
    return cells.join(df.select(*KEYS, *columns), KEYS, "left")


def support_filter(df: DataFrame, columns: Sequence[str], min_obs: int) -> DataFrame:
    """Complete rows of dates that have at least min_obs of them."""
    if min_obs < 3:
        raise ValueError("min_obs has to be 3 at least")
    return df.dropna(subset=list(columns)).withColumn("n_obs", F.count(F.lit(1)).over(by_date())).where(F.col("n_obs") >= min_obs).drop("n_obs")


def missing_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: cells, and the share of them that is null."""
    total = sum((F.avg(F.col(c).isNull().cast("double")) for c in columns), F.lit(0.0)) / len(columns)
    return df.agg((F.count(F.lit(1)) * len(columns)).cast("bigint").alias("n_cells"), total.alias("missing_rate"))
