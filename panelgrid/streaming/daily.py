"""Streaming twins: daily aggregates of an event stream, and late announcements published as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.operators.pit import LagSpec, publish


def daily_panel(events: DataFrame, *, ts: str = "ts", name: str = "user_id", value: str = "value", late: str = "2 days") -> DataFrame:
    """(datetime, instrument, total, n) per day; rows later than ``late`` behind the latest are left out, and days are final then."""
    seen = events.withWatermark(ts, late)
    return seen.groupBy(F.window(ts, "1 day").alias("w"), F.col(name).alias("instrument")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("datetime"), "instrument", "total", "n")


def publish_batches(days: DataFrame, spec: LagSpec, path: str, **kwargs):
    """A foreachBatch function: the events of each batch are kept under path/events, and the instruments
    that it touches are published anew from all their events so far, under path/published. A batch that
    is run again replaces what it wrote before."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        events = spark.read.schema(f"{_ddl(batch)}, batch bigint").parquet(f"{path}/events").where(F.col("batch") <= number)
        touched = events.where(F.col("batch") == number).select(spec.instrument).distinct()
        events = events.drop("batch").join(touched, spec.instrument, "left_semi")
        publish(events, days, spec, **kwargs).write.mode("overwrite").parquet(f"{path}/published/batch={number}")

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def published(spark: SparkSession, path: str) -> DataFrame:
    """What publish_batches has published: of each instrument the rows of the last batch that touched it,
    so the same rows as one publication of all events."""
    rows = spark.read.parquet(f"{path}/published")
    last = rows.groupBy("instrument").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["instrument", "batch"]).drop("batch")
