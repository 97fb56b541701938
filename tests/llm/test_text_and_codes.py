"""Page texts, spelling variants and vector codes: made cases and brute-force versions."""

import hashlib
import html
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelgrid.llm import html_text, spelling, vector_codes

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")

# ---- page texts

ARTICLE = "<h1>A title</h1><p>First paragraph of the text, with <b>bold</b> and a <a href='/x'>link</a> in it.</p><p>Second &amp; last&nbsp;one<br>goes on.</p><p>Ok.</p>"
TEXT = "A title\n\nFirst paragraph of the text, with bold and a link in it.\n\nSecond & last one goes on.\n\nOk."
MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav>"

PAGES = {
    "plain": f"<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style></head><body>{MENU}<article>{ARTICLE}</article><footer>&copy; me</footer></body></html>",
    "upper case and no end": f"<HTML><BODY><DIV CLASS=ad>Buy this now, it is a very good thing to buy, as we all say.</DIV><ARTICLE>{ARTICLE}",
    "no landmarks": f"<body><div id=menu><a href=1>one</a> <a href=2>two</a></div><div class='content'>{ARTICLE}</div><div class='sidebar widget'><p>Popular things that many people have read over the last week.</p></div></body>",
    "comments": f"<main>{ARTICLE}<section id='comments'><p>{'I think so too, very much indeed. ' * 30}</p></section><article class=comment><p>{'Me too! ' * 50}</p></article></main>",
    "notices and forms": f"<div class='cookie-notice'>{'We use cookies. ' * 40}</div><form><p>Your name <input> and a long text about this form</p><textarea>x</textarea></form><article>{ARTICLE}</article>",
    "form around a page": f"<form id=aspnetForm>{MENU}<main>{ARTICLE}</main></form>",
    "scripts inside": f"<article>{ARTICLE.replace('</p><p>Second', '</p><script>var t=&quot;</p><p>no</p>&quot;; if (a < b) document.write(&quot;<p>x</p>&quot;)</script><p>Second')}</article>".replace("&quot;", '"'),
    "comment in markup": f"<article><!-- <p>hidden</p> -- > -->{ARTICLE}<!--></article>-->",
    "quoted angle brackets": f"<article data-x='a > b' title=\"</article>\">{ARTICLE}</article>",
    "hidden": f"<article>{ARTICLE}<p hidden>no</p><p style='display: none'>no</p><div aria-hidden=true>no</div><template><p>no</p></template></article>",
    "list of links": f"<article>{ARTICLE}<ul class=x><li><a href=1>Read this</a></li><li><a href=2>and that</a></li></ul></article>",
    "no end tags": "<body><article><h1>A title<p>First paragraph of the text, with <b>bold</b> and a <a href='/x'>link</a> in it.<p>Second &amp; last&nbsp;one<br>goes on.<p>Ok.</article>",
    "sections": f"<article><header>{ARTICLE.split('<p>')[0]}</header><section><p>{ARTICLE.split('<p>')[1]}</section><div><p>{ARTICLE.split('<p>')[2]}<div><p>Ok.</div></div><footer>tags</footer></article>",
    "teasers": f"<main><article>{ARTICLE}</article></main><section class='related'><article><h2>Another</h2><p>short</p></article></section>",
    "class words that qualify": f"<body class='has-sidebar no-ads'><div class='page with-header'><article class='post has-sidebar'>{ARTICLE}</article></div></body>",
    "stray ends": f"</div></p></b><article></span>{ARTICLE}</div></article></body></html>",
    "page header": f"<header class=top><p>{'A slogan of this site. ' * 20}</p></header><article>{ARTICLE}</article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_text.main_text(PAGES[name]) == TEXT


def test_blocks_and_references():
    table = "<article><p>Some text before the table that is long enough to be read.</p><table><tr><td>a<td>b<tr><td>c &lt;d&gt;</table><ul><li>x<ul><li>y</ul><li>z</ul><dl><dt>t<dd>d</dl><pre>two\n  lines</pre>tail &notanentity; &#8364;&#x41;</article>"
    assert html_text.main_text(table).split("\n\n")[1:] == ["a", "b", "c <d>", "x", "y", "z", "t", "d", "two lines", "tail ¬anentity; €A"]


def test_texts_of_odd_pages():
    for empty in (None, "", "   ", "<html></html>", "<script>x</script>", "<nav>menu only</nav>", "<!-- open", "<"):
        assert html_text.main_text(empty) in ("", "<")
    assert html_text.main_text("just text, no markup 1 < 2") == "just text, no markup 1 < 2"
    assert html_text.main_text("<p>a<p>b") == "a\n\nb"
    same = "<div><p>same length of text</p></div>"
    assert html_text.main_text(f"<body>{same}{same}</body>") == "same length of text\n\nsame length of text"


@pytest.mark.parametrize("piece", ["<div>x", "<b>x", "<p>x", "<a href='", "</div>", "<td>x</div>", "<li>x", "<![x", "<!-- x", "x &amp", "<table><tr><td>", "<h1>x", '<a b="', "<ul><li>"])
def test_long_and_deep_pages_take_linear_time(piece):
    began = time.perf_counter()
    html_text.main_text("<article>" + piece * 40_000)
    once = time.perf_counter() - began
    assert once < 6


@tables
def test_pages_against_their_articles(spark):
    got = {r.page_id: r for r in entry.queries()["op11_html_text"](spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        # all pages of the tables have one article, whose blocks are a heading and paragraphs without end tags
        body = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_pages_of_any_table(spark):
    rows = [(1, "u", PAGES["plain"], "t", 7), (1, "u", PAGES["plain"], "t", 7), (None, None, None, None, None), (2, None, "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0), (2, None, "", 0)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


# ---- spelling variants


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def variants(docs):
    """Every word with its near words, by trying all edits."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = sorted({c for w in n for c in w})
    near = {w: {e for e in edits(w, letters) if e in n and e != w} for w in n}
    form = {w: min((x for x in near[w] if n[x] >= 2 * n[w]), key=lambda x: (-n[x], x), default=None) for w in n}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def words(spark, docs, schema="doc_id long, text string"):
    return {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(docs, schema)).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_of_close_words(spark):
    """Words over few letters, so bigrams repeat within a word, ties are many, and every edit has a partner."""
    r = np.random.default_rng(1)
    pool = ["".join(r.choice(list("abÀ"), int(r.integers(5, 8)))) for _ in range(400)]
    docs = [(i, " ".join(r.choice(pool[: 20 * (i % 20 + 1)], 60))) for i in range(120)]
    want = variants(docs)
    assert words(spark, docs) == want and sum(x[4] for x in want) > 1_000


def test_chains_and_edges(spark):
    counts = {"colour": 40, "color": 20, "colur": 10, "colurr": 5, "colurrs": 3, "banana": 9, "bananana": 9, "anana": 4, "aaaaa": 8, "aaaaaa": 4, "ÀÉÀÉÀ": 6, "ÀÉÀÉ": 90, "×÷×÷×": 3, "abcde": 2}
    docs = [(None, " ".join([w] * n)) for w, n in counts.items()] + [(3, None), (4, ""), (5, "1, 2; ß-ß")]
    want = variants(docs)
    assert words(spark, docs) == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_words_of_any_table(spark):
    assert words(spark, [], "doc_id long, text string") == set()
    rows = [(1, "Straße STRASSE strásse! naïve", "x", 2)] * 4  # repeated rows count each
    got = words(spark, rows, "doc_id long, text string, word string, n int")
    assert got == variants([r[:2] for r in rows]) and {x[0] for x in got} == {"straße", "strasse", "naïve"}
    long_text = [(1, "lengthy words " * 200_000)]
    assert words(spark, long_text) == variants(long_text)


@tables
def test_spelling_query(spark):
    got = {tuple(r) for r in entry.queries()["op12_spelling"](spark, FOLDER).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert got == variants(docs)


# ---- vector codes


def coded(rows):
    """rows: (id, vector, label), ids distinct. Codes by whole integer distances."""
    kept = sorted((i, [int(np.floor(256 * float(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][1]) // 16
    parts = np.array([v for _, v, _ in kept], object).reshape(len(kept), 16, width)
    books = [[list(x) for x in parts[:64, p]] for p in range(16)]
    assign = lambda p: [min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, books[p][e], strict=True)), e)) for x in parts[:, p]]
    for _ in range(2):
        for p in range(16):
            at = assign(p)
            for e in range(len(books[p])):
                own = [x for x, a in zip(parts[:, p], at, strict=True) if a == e]
                if own:
                    books[p][e] = [sum(x[i] for x in own) // len(own) for i in range(width)]
    codes = [assign(p) for p in range(16)]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    error = [sum(sum((a - b) ** 2 for a, b in zip(parts[k, p], books[p][codes[p][k]], strict=True)) for p in range(16)) for k in range(len(kept))]
    by_label = Counter()
    for (_, _, g), e in zip(kept, error, strict=True):
        by_label[g] += e
    return {(i, "".join(f"{codes[p][k]:02x}" for p in range(16)), error[k], by_label[g], digest) for k, (i, _, g) in enumerate(kept)}


VECTORS = "vec_id long, embedding array<float>, label int"


def codes(spark, rows, schema=VECTORS, parts=3):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return {tuple(r) for r in vector_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()}


def test_search_is_that_of_all_distances():
    r = np.random.default_rng(0)
    for n, k, w, high in ((500, 64, 4, 60), (300, 64, 4, 3), (200, 7, 1, 4), (50, 1, 6, 9), (40, 64, 0, 2)):
        x, book = r.integers(-high, high, (n, w)), r.integers(-high, high, (k, w))
        distance = ((x[:, None] - book[None]) ** 2).sum(2)
        at, best = vector_codes.search(x, book)
        assert (at == distance.argmin(1)).all() and (best == distance.min(1)).all()


def test_codes_of_vectors_with_ties(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 32) / 8], [None, 1, 2][i % 3]) for i in range(150)]
    rows += [(500, None, 1), (501, [0.5] * 31 + [None], 1), (502, [0.5] * 31 + [float("nan")], None), (503, [float("inf")] * 32, 2)]
    assert codes(spark, rows) == coded(rows)
    assert codes(spark, rows[:9]) == coded(rows[:9])  # fewer rows than entries


def test_vectors_of_any_table(spark):
    assert codes(spark, []) == set() and codes(spark, [(1, None, 1)]) == set()
    same = [(7, [0.25] * 16, None)] * 3 + [(None, [0.25] * 16, 3), (None, [-0.25] * 16, 3)]
    got = [tuple(r) for r in vector_codes.vector_codes(spark.createDataFrame(same, VECTORS)).collect()]
    assert len(got) == 5 and {r[2] for r in got} == {0} and len({r[0] for r in got}) == 2
    # padded with zeros to a multiple of the parts
    short = [(i, [float(i % 5)] * (3 + i % 20), 1) for i in range(40)]
    assert codes(spark, short) == coded([(i, v + [0.0] * (32 - len(v)), g) for i, v, g in short])
    assert codes(spark, [(1, [], 1), (2, [], 1)]) == coded([(1, [0.0] * 0, 1), (2, [], 1)])
    clash = spark.createDataFrame(rows := [(i, [i / 9] * 16, i % 2, "a", 1, 2) for i in range(70)], "vec_id long, embedding array<float>, label int, id string, code int, error int")
    assert {tuple(r) for r in vector_codes.vector_codes(clash).collect()} == coded([r[:3] for r in rows])
    with pytest.raises(Exception, match="no exact code distance"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e9] * 16, 1)], VECTORS)).collect()


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 3)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=16).astype("float32").tolist(), [None, *range(9)][i % 10]) for i in range(120)]
    assert codes(spark, rows) == coded(rows)


@tables
def test_vector_query(spark):
    got = {tuple(r) for r in entry.queries()["op13_vector_codes"](spark, FOLDER).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()}
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").where(F.col("vec_id").isNotNull()).collect()]
    assert got == coded(rows)
