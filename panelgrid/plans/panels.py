"""The panels that the registered queries use, from the tables of a folder, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.operators.grid import calendar, densify, spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(datetime, pos, instrument, qty, n_lines) by month and supplier, dense."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("datetime"), F.col("l_suppkey").alias("instrument")).agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_lines"))
    return densify(rows, ["qty", "n_lines"])


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(datetime, pos, instrument, val, n_events) by day and user, dense, with many gaps."""
    rows = user_day_rows(spark, sf_dir)
    return densify(rows, ["val", "n_events"])


def user_day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("datetime"), F.col("user_id").alias("instrument")).agg(F.sum("value").alias("val"), F.count(F.lit(1)).alias("n_events"))


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, report_date, announce_date, amount): an order's lines by customer, announced when shipped."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = lines.count()
    both = spread(lines, rows, "l_orderkey").join(spread(orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("instrument"), F.to_date("o_orderdate").alias("report_date"), F.to_date("l_shipdate").alias("announce_date"), F.col("l_quantity").alias("amount"))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar (datetime, pos) of the months in which orders were placed, by their first days."""
    return calendar(read(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("datetime")))


A_SQL = """
a0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS datetime, l_suppkey AS instrument, sum(l_quantity) AS qty, count(*) AS n_lines FROM lineitem GROUP BY 1, 2),
cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS pos FROM (SELECT DISTINCT datetime FROM a0)),
a AS (SELECT c.datetime, c.pos, i.instrument, a0.qty, a0.n_lines FROM cal c CROSS JOIN (SELECT DISTINCT instrument FROM a0) i LEFT JOIN a0 ON a0.datetime = c.datetime AND a0.instrument = i.instrument)
"""

B_SQL = """
b0 AS (SELECT CAST(ts AS DATE) AS datetime, user_id AS instrument, sum(value) AS val, count(*) AS n_events FROM events GROUP BY 1, 2),
bcal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS pos FROM (SELECT DISTINCT datetime FROM b0)),
b AS (SELECT c.datetime, c.pos, i.instrument, b0.val, b0.n_events FROM bcal c CROSS JOIN (SELECT DISTINCT instrument FROM b0) i LEFT JOIN b0 ON b0.datetime = c.datetime AND b0.instrument = i.instrument)
"""

E_SQL = """
ev AS (SELECT o_custkey AS instrument, CAST(o_orderdate AS DATE) AS report_date, CAST(l_shipdate AS DATE) AS announce_date, l_quantity AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ok AS (SELECT * FROM ev WHERE announce_date >= report_date),
days AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS pos FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS datetime FROM orders))
"""
