"""Reading a market store, and what a request needs of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_instruments(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, start, end) of a text file with three tokens a line; other lines are skipped, none at all is an error."""
    token = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(token) == 3).select(token[0].alias("instrument"), F.expr("try_cast(split(trim(value), '\\\\s+')[1] AS DATE)").alias("start"), F.expr("try_cast(split(trim(value), '\\\\s+')[2] AS DATE)").alias("end")).dropna()
    if not rows.limit(1).count():
        raise ValueError(f"no membership in {path}")
    return rows.orderBy("instrument", "start")


def list_instruments(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Instruments that are members on some day of the range: a union over time, not a universe of a date."""
    return intervals.where((F.col("start") <= F.to_date(F.lit(end))) & (F.col("end") >= F.to_date(F.lit(start)))).select("instrument").distinct()


def field_scan(panel: DataFrame, instruments: Sequence, fields: Sequence[str], start: str, end: str) -> DataFrame:
    """The fields of some instruments in a range; filters and columns reach the parquet scan."""
    inside = F.col("instrument").isin(list(instruments)) & F.col("datetime").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return panel.where(inside).select("datetime", "instrument", *fields)


def inventory(panel: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: first_date, last_date, n_dates, n_instruments, n_rows, missing_rate."""
    missing = sum((F.avg(F.col(c).isNull().cast("double")) for c in fields), F.lit(0.0)) / len(fields)
    return panel.agg(F.min("datetime").alias("first_date"), F.max("datetime").alias("last_date"), F.count_distinct("datetime").alias("n_dates"), F.count_distinct("instrument").alias("n_instruments"), F.count(F.lit(1)).alias("n_rows"), missing.alias("missing_rate"))


def domain_check(panel: DataFrame, start: str, end: str) -> DataFrame:
    """One row: problem texts of a request that the store can't serve; an empty array if there are none."""
    one = panel.agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi"), F.count_if(F.col("datetime").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("n"))
    problems = F.array(F.when(F.col("lo") > F.to_date(F.lit(start)), "starts before the first day"), F.when(F.col("hi") < F.to_date(F.lit(end)), "ends after the last day"), F.when(F.col("n") == 0, "no rows"))
    return one.select(F.array_compact(problems).alias("problems"))


def write_snapshots(panel: DataFrame, path: str) -> DataFrame:
    """Parquet by date, and (datetime, n, content): a hash of each date's rows that doesn't depend on their order or on the order
    of columns. Rows' digests are added up in two halves, so tasks combine their parts of a date and none holds it whole;
    repeated rows count."""
    panel.write.partitionBy("datetime").parquet(path)
    digest = F.sha2(F.to_json(F.struct(*sorted(panel.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring("_digest", at, 15), 16, 10).cast("decimal(20,0)"))
    sums = panel.select("datetime", digest.alias("_digest")).groupBy("datetime").agg(F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(16).alias("b"))
    return sums.select("datetime", "n", F.sha2(F.concat_ws(",", "n", "a", "b"), 256).alias("content"))
