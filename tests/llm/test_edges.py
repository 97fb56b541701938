"""Nulls, empty tables, repeated rows, very long texts, clashing columns and bounds of the earlier operators."""

import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelgrid.llm import embedding_dedup, license_scan, packing, pii, quality, url_filter
from panelgrid.llm import queries as q

# ---- personal data


def test_addresses_are_those_of_the_pattern():
    r = random.Random(2)
    for _ in range(5_000):
        text = "".join(r.choice("01259.. a") for _ in range(r.randint(1, 40)))
        assert pii._addresses(text) == [("ip", *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


@pytest.mark.parametrize("piece", ["1", "1.", "at-", "at ", "call (555) 123-4567 or a@b.co, ", "joe at box dot com ", "aB3", "+1(", "(", "A1B2 ", "a@"])
def test_long_texts_of_one_piece_take_linear_time(piece):
    model, least = pii.trained()
    began = time.perf_counter()
    text = piece * (600_000 // len(piece))
    spans = pii._chosen([text], model, least)[0]
    assert time.perf_counter() - began < 6
    assert all(text[s:e] for _, s, e in spans)


def test_long_secrets_and_names_are_one_span():
    model, least = pii.trained()
    r = random.Random(1)
    key = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFG0123456789") for _ in range(900))
    name = "averyveryverylongnameofsomebody.whoreallylikestowriteitall.out"
    text = f'token = "{key}" and write to {name} (at) corp [dot] com now'
    found = {k: text[s:e] for k, s, e in pii._chosen([text], model, least)[0]}
    assert found == {"secret": key, "email_spelled": f"{name} (at) corp [dot] com"}


def test_spans_of_any_table(spark):
    rows = [(1, "mail a@b.co", "x", 1)] * 2 + [(None, None, None, None), (3, "", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, id int")
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find(df).collect()]
    assert got == [(1, [("email", 5, 11)])] * 2 + [(None, []), (3, [])]
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).columns == df.columns
    assert [r.text for r in pii.redact(df).collect()] == ["mail [EMAIL]"] * 2 + [None, ""]


# ---- quality


def test_the_sample_is_bounded_however_often_ids_repeat(spark):
    rows = [(i, f"word{i % 7} and some text {i}" * (1 + i % 3), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 500 + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] * 2, "doc_id long, quality int")
    model = quality.fit(docs, labels)
    once = quality.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), labels)
    assert np.allclose(model.weights, once.weights) and (model.bias, model.slope, model.shift) == pytest.approx((once.bias, once.slope, once.shift))
    assert quality.fit(docs.limit(0), labels).score(np.array([], int)) == pytest.approx(0.5)


def test_scores_of_any_table(spark):
    model = quality.fit_rows([np.array([1, 2]), np.array([3])] * 8, np.array([1, 0] * 8))
    rows = [(1, "some text", "x", 2.0)] * 2 + [(None, None, None, None), (2, "x" * 2_000_000, "y", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, score double")
    got = quality.score(df, model).collect()
    assert [r.doc_id for r in got] == [1, 1, None, 2] and got[0].score == got[1].score and all(0 <= r.score <= 1 for r in got)
    assert quality.score(df.limit(0), model).count() == 0 and quality.keep(df, model, least=0.0).columns == df.columns


# ---- packing


def test_packing_leaves_only_what_the_result_reads(spark):
    r = np.random.default_rng(0)
    parts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(r.integers(1, 1_025, 700))], "id long, length long")
    out = packing.pack(parts)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    newest = max((f"{root}/{f}" for f in os.listdir(root) if f.startswith("scratch-")), key=os.path.getmtime)
    assert len(os.listdir(newest)) == 2  # the pieces, and their places
    placed = out.groupBy("sequence_id").agg(F.sum("length").alias("used")).collect()
    total = out.agg(F.sum("length"), F.count(F.lit(1))).first()
    assert total[1] == 700 and max(p.used for p in placed) <= 1_024 and len(placed) <= 1.02 * total[0] / 1_024 + 12


# ---- empty tables, clashing columns


def test_empty_tables(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_links(vectors).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), url_filter.rules_table(spark, q.URL_RULES)).count() == 0
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mit license", "a", 1, "b")] * 2 + [(None, None, None, None, None)], "doc_id long, text string, places string, id int, row string")
    assert [r.n_words for r in license_scan.scan(docs).collect()] == [2, 2, 0]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1, "x", 2), (2, [1.0, 0.01], 1, "y", 3), (3, None, 1, "z", 4)], "vec_id long, embedding array<float>, label int, id string, n_links int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_links(vectors).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    pages = spark.createDataFrame([(1, "http://a.com/x", "h", "r", "v")], "page_id long, url string, host string, rule string, id string")
    assert url_filter.filter_urls(pages, url_filter.rules_table(spark, q.URL_RULES)).first().verdict == "allow"


def test_pipeline_of_nulls_and_of_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, "en", "web", 0), (2, "", "en", "web", 0), (3, "some plain text that reads well", "en", None, None)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in (("full", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert (len(got) > 0) == (name == "full")
    assert re.match("best-fit", corpus_pipeline.STAGES[-1][0])


# ---- licenses


def wording(template, holder="Jane Doe and others", optional=True):
    """A text that a template has to accept."""
    text = re.sub(r"<<(\d+)>>", lambda m: " ".join(holder.split()[: int(m[1])]), template)
    return re.sub(r"\[\[(.*?)\]\]", r"\1" if optional else "", text)


@pytest.mark.parametrize("optional", [True, False])
@pytest.mark.parametrize("k", range(len(license_scan.TEXTS)))
def test_whole_license_texts(spark, k, optional):
    label, template = license_scan.TEXTS[k]
    automaton = license_scan.Automaton(license_scan.TEMPLATES)
    text = f"Copyright (c) 2020 someone. {wording(template, optional=optional)}. The end."
    words = license_scan.words_of(text)
    found = automaton.run(words)
    start, end, _ = next(f for f in found if f[2] == label and f[1] - f[0] > 40)
    assert b" ".join(words[end:]) == b"the end"
    # a mandatory word that is missing, or another in its place, is no such text
    for broken in (words[: start + 10] + words[start + 11 :], [*words[: start + 10], b"otherwise", *words[start + 11 :]]):
        if optional:
            assert not any(f[2] == label and f[1] - f[0] > 40 for f in automaton.run(broken))


def test_license_scores_follow_the_wording(spark):
    whole = wording(dict(license_scan.TEXTS)["mit"])
    rows = [(1, whole), (2, "under the mit license"), (3, "gnu lesser general public license is a thing I hate"), (4, "nothing"), (5, None), (5, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id").collect()
    score = [r.score for r in got]
    assert score[0] > 0.99 > score[2] > score[1] > 0.5 and score[3:] == [0.0, 0.0, 0.0]
    long_text = "this software is " * 300_000 + "under the mit license"
    began = time.perf_counter()
    assert license_scan.scan(spark.createDataFrame([(1, long_text)], "doc_id int, text string")).first().places[-1].label == "mit"
    assert time.perf_counter() - began < 20


# ---- rules by a shuffle


def test_rules_joined_by_a_shuffle(spark, monkeypatch):
    hosts = ["a.com", "x.a.com", "b.net", "deep.x.a.com", "c.org", None]
    urls = [(i, None if h is None else f"http://{h}/en/p{i}?q") for i, h in enumerate(hosts * 4)]
    rules = url_filter.rules_table(spark, (("block", "a.com", "/"), ("allow", "x.a.com", "/en/"), ("block", "net", "/en/p2"), ("block", "c.org", "/fr/")))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    run = lambda: sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()), key=str)
    broadcast = run()
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert run() == broadcast and {r[3] for r in broadcast} == {"a.com/", "x.a.com/en/", "net/en/p2", None}
