"""Reports of runs: tables and a document that readers see all together or not at all.

An attempt writes into a folder of its own under the run's; its manifest is put in place last, by one rename.
A reader begins at the manifest, so an attempt that fails half-way leaves nothing that a reader would meet, and a
run's earlier report stands until the next one is whole. All files are written where the root lies, by Spark and its
file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: What every report says of its origin.
PROVENANCE = ("git_sha", "config_hash", "data_snapshot_hash", "interpreter", "package_versions", "random_seeds")
MANIFEST = "manifest.json"


class ReportError(ValueError):
    pass


class Reports:
    """The reports under one root, a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def _run(self, run: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
            raise ReportError(f"{run!r} can't name a run's folder")
        return f"{self.root}/{run}"

    def _put(self, at: str, payload: Any) -> None:
        out = self._fs.create(self._path(at), True)
        out.write(bytearray((json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n").encode()))
        out.close()

    def _get(self, at: str) -> Any:
        stream = self._fs.open(self._path(at))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _replace(self, source: str, target: str) -> None:
        """One rename that puts a file in another's place."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self._path(source), self._path(target), options)

    def publish(self, run: str, document: Mapping[str, Any], tables: Mapping[str, DataFrame], *, provenance: Mapping[str, Any]) -> str:
        """Writes the tables, then the document with its provenance, then the manifest; returns the attempt's folder. A run that has a
        report gets the new one in its place, and the old attempt's files go after that."""
        if missing := [k for k in PROVENANCE if k not in provenance]:
            raise ReportError(f"a report has to say its {', '.join(missing)}")
        folder, attempt = self._run(run), f"attempt-{uuid.uuid4().hex}"
        place = f"{folder}/{attempt}"
        rows = {}
        for name, df in tables.items():
            if not re.fullmatch(r"\w+", name):
                raise ReportError(f"{name!r} can't name a table")
            df.write.parquet(f"{place}/{name}")
            rows[name] = self.spark.read.schema(df.schema).parquet(f"{place}/{name}").count()
        self._put(f"{place}/report.json", {**document, "provenance": dict(provenance)})
        before = self._manifest(run)
        self._put(f"{folder}/.{attempt}", {"attempt": attempt, "tables": rows})
        self._replace(f"{folder}/.{attempt}", f"{folder}/{MANIFEST}")
        if before is not None:
            self._fs.delete(self._path(f"{folder}/{before['attempt']}"), True)
        return place

    def _manifest(self, run: str) -> dict | None:
        at = f"{self._run(run)}/{MANIFEST}"
        return self._get(at) if self._fs.exists(self._path(at)) else None

    def read(self, run: str) -> tuple[dict, dict[str, DataFrame]]:
        """The document and the tables of the run's report; an error if it has none that is whole."""
        manifest = self._manifest(run)
        if manifest is None:
            raise ReportError(f"there is no report of {run}")
        place = f"{self._run(run)}/{manifest['attempt']}"
        return self._get(f"{place}/report.json"), {name: self.spark.read.parquet(f"{place}/{name}") for name in manifest["tables"]}

    def discard_unfinished(self, run: str) -> int:
        """Deletes attempts of a run that never became its report; returns how many."""
        manifest, dropped = self._manifest(run), 0
        kept = manifest["attempt"] if manifest else None
        folder = self._path(self._run(run))
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            name = status.getPath().getName()
            if name.lstrip(".").startswith("attempt-") and name != kept:
                dropped += self._fs.delete(status.getPath(), True) and not name.startswith(".")
        return dropped
