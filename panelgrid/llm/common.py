"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(c, UPPER, LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset a local
    session (tests) gets a temporary one; on a cluster that is an error, for no machine's own folder will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="panelgrid-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so lost executors cost a re-read only."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one call, written to the shared folder and deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self._paths = spark, 0, {}
        self.folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, tasks: int | None = None) -> DataFrame:
        """The table, read back by at most so many tasks: a small one would otherwise be dealt over as many as the
        session has partitions in each join, while of a single task joins and groups need no shuffle."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out = out if tasks is None else out.coalesce(tasks)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self._paths:
                delete(self.spark, self._paths.pop(id(t))[1])


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a local relation, which needs no job when it is broadcast."""
    import pyarrow as pa

    names, types = zip(*(part.split() for part in schema.split(", ")), strict=True)
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names)))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settled(df: DataFrame, rows_each: int = 50_000) -> DataFrame:
    """Checkpointed, and read back in no more tasks than its rows are worth: a small table would
    otherwise write as many files in each later shuffle as the session has partitions."""
    df = checkpointed(df)
    parts = -(-df.count() // rows_each) or 1
    return df.coalesce(parts) if parts < shuffle_partitions(df.sparkSession) else df
