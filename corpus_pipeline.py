"""A training corpus from documents: quality, copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents,
whatever their names; the last returns the packed pieces.

Null texts count as empty (and stay null): the classifier scores them as any other text, equal ones
are copies of each other, they have no near copies and no personal data, and are packed as a final id
alone. Rows of a null id are kept unless the classifier rejects them or a row with an id has the same
text. Rows that repeat an id and a text stay together. Texts of any length are read whole. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.llm import exact_dedup, minhash, packing, pii, quality
from panelgrid.llm import queries as llm
from panelgrid.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), where=~llm.held_out())
    return quality.keep(docs, model, least=llm.QUALITY_LEAST)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return minhash.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence."""
    return packing.pack(llm.packed_pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("pii redaction", pii_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
