"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z. Groups are combined in three steps, each
comparing digest and full text: within a task (the partial aggregate, which leaves one row of a text
to each task), within a salt of the digest, which is dealt by task, and then the salts' winners over
all. So of a text that a third of all rows have no task reads more rows than there are tasks. Rows then
find their group by its digest; texts that share a digest, should that ever be, by the text.

Null texts count as empty; texts of any length are compared whole; of equal texts the row with the
largest id stays (a null id only if all are null). Rows that repeat an id count each, and are all kept
if that id stays. An empty table gives an empty result. Other columns, of any name, aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

#: Parts that the tasks' winners of a digest are dealt into.
SALTS = 16


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return df.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", F.sha2("norm", 256))


def _combined(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text, as it is after lower-casing: digest, norm, keep_id, group_size."""
    rows = _keyed(df, id_col, text_col).select("digest", "norm", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    salted = _combined(rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))), "digest", "salt")
    return _combined(salted, "digest")


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256 (of the lower-cased text)."""
    found = groups(df, id_col=id_col, text_col=text_col, salts=salts)
    by_digest = checkpointed(found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    keyed = _keyed(df, id_col, text_col)
    alone = by_digest.where("group_size = 1").select(F.col("keep_id").alias("id"), "keep_id", "group_size", "digest")
    # every row of a digest that has one text belongs to that text: a join without texts, whose hot keys AQE splits
    shared = keyed.select("id", "digest").join(by_digest.where("group_size > 1 and texts = 1"), "digest").select("id", "keep_id", "group_size", "digest")
    # digests of several texts are collisions of SHA-256, of which none is known: small enough to broadcast
    clash = keyed.join(F.broadcast(by_digest.where("texts > 1").select("digest")), "digest", "left_semi")
    clash = clash.join(_combined(clash.withColumnsRenamed({"id": "keep_id"}).withColumn("group_size", F.lit(1).cast("bigint")), "digest"), ["digest", "norm"]).select("id", "keep_id", "group_size", "digest")
    out = alone.unionByName(shared).unionByName(clash)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns. A row of a null id stays if no equal text has an id."""
    lost = exact_dedup(df, id_col=id_col, text_col=text_col).where("not kept").select(F.struct(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest")).alias("lost")).distinct()
    # the columns of df in a struct, so that no name of theirs can clash
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("own_id"), F.sha2(norm, 256).alias("own_digest"))
    same = F.col("own_id").eqNullSafe(F.col("lost.id")) & (F.col("own_digest") == F.col("lost.digest"))
    return rows.join(lost, same, "left_anti").select("row.*")
