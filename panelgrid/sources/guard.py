"""A store that is only read: what it holds, whether it stays so, and whether it stands apart."""

from __future__ import annotations

import hashlib
import platform
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of names that only caches have.
CACHE_MARKERS = ("qlib_cache", "expression_cache", "dataset_cache", "cache", "mlruns")


class StoreError(AssertionError):
    pass


@dataclass(frozen=True)
class Fingerprint:
    files: int
    total_bytes: int
    newest: str
    content: str  # of paths, sizes and times; it doesn't depend on the order in which they are listed


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime): Spark lists the tree and doesn't open its files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256, md5) of every file, read where the executors are; each file is one row's content, as Spark's
    binary source has it (2 GB at most)."""
    from panelgrid.functions.text import digests

    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return read.select("path", "length", digests(F.col("content")).alias("d")).select("path", "length", "d.*")


def fingerprint(spark: SparkSession, root: str) -> Fingerprint:
    """One aggregate over the listing. A root that isn't there is an error, as nothing can be guaranteed of it."""
    if not _exists(spark, root):
        raise StoreError(f"there is no store at {root}")
    digest = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("double").cast("string")), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0))
    one = _files(spark, root).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b"), F.max("modificationTime").alias("t"), part(1).alias("x"), part(16).alias("y")).first()
    return Fingerprint(one.n, one.b, str(one.t), hashlib.sha256(f"{one.x},{one.y}".encode()).hexdigest())


def _exists(spark: SparkSession, at: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


@contextmanager
def unchanged(spark: SparkSession, root: str) -> Iterator[Fingerprint]:
    """Raises StoreError at the end of the block if the store isn't as it was at its beginning."""
    before = fingerprint(spark, root)
    yield before
    if (after := fingerprint(spark, root)) != before:
        raise StoreError(f"the store at {root} changed while it was read: {before} became {after}")


def _within(inner: str, outer: str) -> bool:
    return (inner.rstrip("/") + "/").startswith(outer.rstrip("/") + "/")


def check_isolation(spark: SparkSession, store: str, *, project: str, caches: str) -> None:
    """The store is a folder outside the project, no cache lies inside it, and nothing in it is named like one."""
    if not _exists(spark, store):
        raise StoreError(f"there is no store at {store}")
    if _within(caches, store):
        raise StoreError(f"the caches at {caches} lie inside the store {store}")
    if _within(store, project):
        raise StoreError(f"the store {store} lies inside the project {project}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    names = [x.getPath().getName() for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    if odd := sorted(n for n in names if any(m in n.lower() for m in CACHE_MARKERS)):
        raise StoreError(f"the store {store} holds what only a run could have left: {', '.join(odd)}")


def paths_inside(value: Any, store: str, at: str = "settings") -> list[str]:
    """Where settings name a path strictly inside the store; the store itself may be named."""
    if isinstance(value, str):
        return [at] if _within(value, store) and value.rstrip("/") != store.rstrip("/") else []
    items = value.items() if isinstance(value, Mapping) else enumerate(value) if isinstance(value, (list, tuple, set)) else ()
    return [found for k, v in items for found in paths_inside(v, store, f"{at}.{k}")]


def environment(spark: SparkSession, required: Mapping[str, str] = {}) -> dict[str, Any]:  # noqa: B006
    """Versions of what runs, and how they differ from the required ones (by distribution), for a report's provenance."""
    found = {name: _version(name) for name in ("pyspark", "numpy", "pandas", "pyarrow", *required)}
    differ = {name: (wanted, found[name]) for name, wanted in required.items() if found[name] != wanted}
    return {"interpreter": platform.python_version(), "spark": spark.version, "package_versions": found, "differ": differ}


def _version(name: str) -> str | None:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return None
