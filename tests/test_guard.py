"""Stores that are only read, text and digest columns, chains of processors."""

import datetime as dt
import hashlib
import os
import statistics

import pytest
from pyspark.sql import functions as F

from panelgrid.functions import text
from panelgrid.operators import processors
from panelgrid.sources import guard


def test_a_store_that_changes_is_noticed(spark, tmp_path):
    store = tmp_path / "store"
    (store / "day").mkdir(parents=True)
    (store / "day" / "a.bin").write_bytes(b"one")
    (store / "b.txt").write_text("two")
    with guard.unchanged(spark, str(store)) as seen:
        assert (seen.files, seen.total_bytes) == (2, 6)
    for change in (lambda: (store / "c.txt").write_text("new"), lambda: (store / "c.txt").unlink(), lambda: os.utime(store / "b.txt", (1, 1))):
        with pytest.raises(guard.StoreError, match="changed while it was read"):
            with guard.unchanged(spark, str(store)):
                change()
    with pytest.raises(guard.StoreError, match="no store"):
        guard.fingerprint(spark, str(tmp_path / "none"))
    found = {os.path.basename(r.path): (r.sha256, r.md5) for r in guard.file_digests(spark, str(store)).collect()}
    assert found == {n: (hashlib.sha256(c).hexdigest(), hashlib.md5(c).hexdigest()) for n, c in (("a.bin", b"one"), ("b.txt", b"two"))}


def test_isolation(spark, tmp_path):
    store, project = tmp_path / "data" / "store", tmp_path / "project"
    store.mkdir(parents=True)
    check = lambda s=store, c=project / "cache": guard.check_isolation(spark, str(s), project=str(project), caches=str(c))
    check()
    (project / "inside").mkdir(parents=True)
    for args, says in (((tmp_path / "none",), "no store"), ((store, store / "x"), "lie inside the store"), ((store, store), "lie inside the store"), ((project / "inside",), "inside the project")):
        with pytest.raises(guard.StoreError, match=says):
            check(*args)
    (store / "Expression_Cache").mkdir()
    with pytest.raises(guard.StoreError, match="Expression_Cache"):
        check()
    settings = {"provider": "/d/store", "out": ["/d/store/x", "/d/store2"], "more": {"deep": "/d/store/y/z"}}
    assert guard.paths_inside(settings, "/d/store") == ["settings.out.0", "settings.more.deep"]


def test_environment(spark):
    got = guard.environment(spark, {"numpy": "0.0.1", "no-such-package": "1"})
    assert got["spark"] == spark.version and set(got["differ"]) == {"numpy", "no-such-package"} and got["package_versions"]["no-such-package"] is None


def test_text_columns(spark):
    rows = [("a \r\n\r\n\r\n\r\nb\t\rc\x00d  ", "Ein Bild: 中文 (1).png", 0), ("", "///", 1023), ("x", "a_b", 1536), (None, None, None), ("", "_", 5 * 1024**3), ("", "", 1024**2)]
    df = spark.createDataFrame(rows, "t string, n string, s long").select(text.tidy(F.col("t")).alias("t"), text.safe_stem(F.col("n")).alias("n"), text.human_size(F.col("s")).alias("s"))
    assert [tuple(r) for r in df.collect()] == [("a\n\nb\ncd", "Ein_Bild_中文_1_.png", "0 B"), ("", "document", "1023 B"), ("x", "a_b", "1.5 KB"), (None, None, None), ("", "document", "5.0 GB"), ("", "document", "1.0 MB")]


def test_chain_learns_from_the_training_window(spark):
    day = lambda k: dt.date(2024, 1, k)
    rows = [(day(1 + k // 4), k % 4, None if k == 5 else float(k * k), None if k == 6 else float(k)) for k in range(16)]
    df = spark.createDataFrame(rows, "datetime date, instrument int, x double, y double")
    specs = [{"class": "RobustZScoreNorm", "kwargs": {"fields_group": "feature", "clip_outlier": True}}, {"class": "Fillna", "kwargs": {"fields_group": "feature"}}, {"class": "DropnaLabel"}, {"class": "CSRankNorm", "kwargs": {"fields_group": "label"}}]
    out = processors.fit_chain(specs, df.where("datetime < DATE '2024-01-03'"), ["x"], "y")(df)
    seen = [x for d, _, x, _ in rows if d < day(3) and x is not None]
    middle = statistics.median(seen)
    scale = 1.4826022 * statistics.median(abs(x - middle) for x in seen)
    got = {(r.datetime, r.instrument): (r.x, r.y) for r in out.collect()}
    assert len(got) == 15 and (day(2), 2) not in got and got[day(2), 1][0] == 0.0
    assert got[day(1), 3] == (pytest.approx((9 - middle) / scale), 4 / 5) and got[day(4), 3] == (3.0, 4 / 5) and got[day(2), 3][1] == 3 / 4
    for bad in ({"class": "Other"}, {"class": "Fillna", "kwargs": {"fields_group": "x"}}):
        with pytest.raises((KeyError, ValueError)):
            processors.fit_chain([bad], df, ["x"], "y")
