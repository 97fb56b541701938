import hashlib
import re

import numpy as np
import pytest

from panelgrid.llm import bpe, embedding_dedup, exact_dedup, license_scan, lm_score, minhash, packing, pii, quality, url_filter
from panelgrid.llm import queries as q

MULTI = f"{q.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
DOCS = "doc_id bigint, text string, digest string, norm string"  # with names that the operators use inside
ROWS = [(1, "Hello  world \n\n it's 42!", "", ""), (2, None, None, None), (3, "", "", ""), (4, "hello  WORLD \n\n it's 42!", "", ""), (5, "é" * 50 + "   x" * 40, "", ""), (5, "é" * 50 + "   x" * 40, "", ""), (None, "null id", "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_sequential_scan(spark, docs, empty):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=q.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    made = bpe.encode(docs, MULTI, q.PATTERN, chunk_chars=24, overlap_chars=8)
    want = sorted((str(r[0]), enc.encode_ordinary(r[1] or "")) for r in ROWS)
    assert sorted((str(r.doc_id), r.ids) for r in made.collect()) == want
    back = bpe.decode(made, MULTI, q.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((r[1] or "").encode() for r in ROWS)
    assert bpe.encode(empty, MULTI, q.PATTERN, digest=True).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "byte_bpe_50k"])
def test_bpe_stitches(spark, name):
    """White space, contractions and punctuation at the cuts: at default sizes and in short chunks."""
    import tiktoken

    path = f"{q.TOKENIZERS}/{name}.tiktoken"
    enc = tiktoken.Encoding("t", pat_str=q.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    stride, words = bpe.CHUNK_CHARS - bpe.OVERLAP_CHARS, "some words that go on and on; " * 2000
    at_cut = [words[: stride - 1] + gap + words[: bpe.CHUNK_CHARS // 8] for gap in ("\n\n", "\xa0\xa0", "\n\n\n", "'ll", "  ", " \t ")]
    ends = [words[: bpe.CHUNK_CHARS - k] + "'ll go " + words[:3000] for k in (1, 2, 3)]
    unbroken = ["x" * 70_000, " " * 70_000, "word " + "\n" * 40_000 + "word"]
    texts = [*at_cut, *ends, *unbroken, "a b " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: r.ids for r in bpe.encode(df, path, q.PATTERN).collect()} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    r = np.random.default_rng(9)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\xa0", "'", "'s", "'ll", "a", "Bc", "7", "!", "é", "日本", "\x1c"]
    texts = ["".join(r.choice(parts, 60)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, path, q.PATTERN, chunk_chars=24, overlap_chars=10).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    sha = hashlib.sha256(b"hello  world \n\n it's 42!").hexdigest()
    assert by[1, sha].keep_id == 4 and not by[1, sha].kept and by[4, sha].group_size == 2
    assert by[2, hashlib.sha256(b"").hexdigest()].keep_id == 3
    assert exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.exact_dedup(empty).count() == 0


def test_hot_groups_over_many_tasks(spark):
    df = spark.range(0, 4000, 1, 40).selectExpr("id AS doc_id", "if(id % 2 = 0, 'Same', concat('t', id)) AS text")
    got = exact_dedup.exact_dedup(df).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, 3998 if i % 2 == 0 else i, 2000 if i % 2 == 0 else 1) for i in range(4000)}


def test_dropped_copies(spark, empty):
    """Repeated and null ids, ties, a long text, and columns named as those inside."""
    long = "Long text " * 20_000
    rows = [(5, "a"), (5, "b"), (6, "A"), (7, long), (8, long.upper()), (None, "b"), (None, "only null"), (None, "ONLY null"), (9, None), (10, "")]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id bigint, text string, lost_id int, keep_id int, row int, digest string")
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and exact_dedup.drop_copies(empty).count() == 0
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in kept.collect()) == [("10", ""), ("5", "b"), ("6", "A"), ("8", "LONG TEXT"), ("None", "ONLY null"), ("None", "only null")]


def test_pii(spark, empty):
    text = "mail a.b@c.de.fr, ip 1.2.3.4 and 300.1.1.1, +1 (555) 123-4567, 4111 1111 1111 1111; token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\""
    kinds = [s.kind for s in pii.find(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().spans]
    assert kinds[:4] == ["email", "ip", "card", "phone"] and "secret" in kinds
    clean = spark.createDataFrame([(1, "A plain sentence with 12 words, version 3.1.4 of it. " * 20), (2, None)], "doc_id int, text string")
    assert [list(r.spans) for r in pii.find(clean).collect()] == [[], []]
    assert pii.redact(clean).first().text == clean.first().text and pii.find(empty).count() == 0


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 8))
    vecs = np.concatenate([base, base[:10] + 0.05 * r.normal(size=(10, 8)), base[:3]])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8)], "vec_id bigint, embedding array<double>")
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(u))
    for _ in range(50):
        label = np.minimum(label, np.where(near, label[None], 999).min(1))
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.embedding_links(df, tile_rows=8, block_rows=4, top=2, fanout=2).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {i: (int(near[i].sum()), int(label[i])) for i in range(len(u))}
    assert got[100] == (0, 100) and got[102] == (0, 102)


def test_urls(spark):
    urls = ["http://a.Example.com/en/1?x", "https://www.example.com/en/1", "http://x.net/es/q#t", "notaurl", None, "http://example.com", "http://badexample.com/en/", "http://x.net/es/q#t"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_table(spark, q.URL_RULES)).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][2] is None and got[6][2] == "com/" and len(got) == len(urls)


def test_packing(spark, docs, empty):
    got = packing.pack(packing.pieces(docs, f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken", q.PATTERN, capacity=16), capacity=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 16
    assert packing.pack(packing.pieces(empty, f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken", q.PATTERN)).count() == 0


def test_packing_reads_special_tokens_as_the_tokenizer_does(spark):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{q.TOKENIZERS}/byte_bpe_50k.json")
    texts = ["x <|endoftext|> y", "<|endoftext|><|endoftext|>", " <|endoftext| >", "a  <|endoftext|>\n\n b", None, ""]
    got = q.packed_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert {(r.id, r.length, r.ids_crc32) for r in got} == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


@pytest.mark.parametrize("rows_each, low, high", [(150, 1, 1025), (100_000, 200, 700), (100_000, 300, 400), (100_000, 1, 100), (100_000, 7, 8)])
def test_packing_matches_best_fit_decreasing(spark, monkeypatch, rows_each, low, high):
    """As few sequences as one piece at a time (one more at most), whatever the number of tasks."""
    monkeypatch.setattr(packing, "ROWS_EACH", rows_each)
    lengths = np.random.default_rng(low).integers(low, high, 2000)
    parts = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(parts).collect()
    assert sorted((r.id, r.length) for r in got) == [(i, n) for i, n in enumerate(lengths)]
    by, free = {}, []
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    for n in sorted(lengths, reverse=True):
        at = min((k for k, f in enumerate(free) if f >= n), key=free.__getitem__, default=None)
        if at is None:
            free.append(1024 - n)
        else:
            free[at] -= n
    assert len(by) <= len(free) + 1


def test_quality(spark):
    good = [(i, f"the cat number {i} sat on the mat and looked at tree {i * 7 % 13}.") for i in range(60)]
    bad = [(100 + i, f"BUY {i}!!! CLICK {i}!!! " * 3) for i in range(30)]
    df = spark.createDataFrame(good + bad + [(999, None)], "doc_id bigint, text string")
    marks = df.where("doc_id < 999").selectExpr("doc_id", "cast(doc_id < 100 as int) AS quality")
    model = quality.fit(df, marks)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.5) == (i < 100) for i in got if i < 999) and 0 <= got[999] <= 1
    assert 0 < quality.fit(df, marks.limit(0)).score(np.zeros(0, int)) < 1


def test_minhash(spark, empty):
    r = np.random.default_rng(1)
    rows, word = [], lambda: f"w{r.integers(10**6)}"
    for g in range(5):
        base = [word() for _ in range(200)]
        for k in range(6):
            own = list(base)
            own[int(r.integers(200))] = word()
            rows.append((10 * g + k, " ".join(own)))
    df = spark.createDataFrame([*rows, (900, None), (901, "Few words"), (902, "few  WORDS")], "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_dups(df).collect()}
    assert all(got[i] == i // 10 * 10 for i in got if i < 900) and got[900] == 900 and got[902] == 901
    assert minhash.near_dups(empty).count() == 0


def test_license(spark):
    text = "Licensed under the Apache License, Version 2.0. Released under the MIT License; GNU General Public License"
    r = license_scan.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(p.start, p.label) for p in r[0].places if p.base] == [(3, "apache"), (11, "mit"), (14, "gpl")] and r[0].n_words == 17
    assert "apache-2.0" in {p.label for p in r[0].places} and r[1].n_words == 0


def test_language_model(spark):
    text = "a b c d e f g h " * 30
    df = spark.createDataFrame([(i, text) for i in range(40)] + [(99, None)], "doc_id bigint, text string")
    model = lm_score.fit(df, rounds=3)
    got = {r.doc_id: r for r in lm_score.score(df, model).collect()}
    net, own = lm_score.Network(model[1]), np.array(lm_score.Classes(model[0]).of(text))
    around, plain = lm_score.Network.contexts(own), 0.0
    for c, t in zip(around, own):
        h = np.tanh(sum(net.embed[x] @ net.inner[k] for k, x in enumerate(c)) + net.shift)
        h, (group, member) = np.append(h, 1), divmod(t, lm_score.MEMBERS)
        for z, k in ((h @ net.groups, group), (h @ net.members[group], member)):
            plain += z[k] - np.log(np.exp(z).sum())
    assert got[0].log_likelihood == pytest.approx(plain, rel=1e-3) and got[0].n_tokens == len(own) and got[99].log_likelihood == 0


def brute_components(texts):
    """id -> least id that it reaches, of id -> words, by the sets of five-word shingles."""
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in texts.items()}
    ids, up = sorted(sets), {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def crowd(r, groups, size, shared, own, changed):
    """Groups of near copies that all share a passage: id -> words."""
    passage = [f"p{k}" for k in range(shared)]
    texts = {}
    for g in range(groups):
        base = passage + [f"w{r.integers(10**7)}" for _ in range(own)]
        for _ in range(size):
            words = list(base)
            for at in r.integers(shared, shared + own, changed):
                words[at] = f"x{r.integers(10**7)}"
            texts[len(texts)] = words
    return texts


@pytest.mark.parametrize("rows_each", [20_000, 500])
def test_minhash_in_crowds_of_small_components(spark, monkeypatch, rows_each):
    """700 texts share more than half of their words; pairs of them link. Also over many short tasks."""
    monkeypatch.setattr(minhash, "ROWS_EACH", rows_each)
    monkeypatch.setattr(minhash, "ROWS_WITH_SETS", rows_each)
    texts = crowd(np.random.default_rng(5), groups=350, size=2, shared=70, own=60, changed=1)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_dups(df).collect()}
    want = brute_components(texts)
    together = {i for i, c in want.items() if c != i}
    assert len(together) > 300 and sum(got[i] == want[i] for i in together) >= 0.98 * len(together)
    assert all(got[i] in (want[i], i) for i in got)


def test_minhash_of_a_large_component_and_its_edge(spark):
    """A chain of overlapping texts and a crowd that links loosely."""
    r = np.random.default_rng(7)
    words = [f"c{k}" for k in range(1500)]
    texts = {k: words[10 * k : 10 * k + 120] for k in range(130)}
    for i, t in crowd(r, groups=1, size=200, shared=40, own=80, changed=4).items():
        texts[1000 + i] = t
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    assert {x.doc_id: x.component_id for x in minhash.near_dups(df).collect()} == brute_components(texts)


def test_minhash_rows_without_own_ids_and_clashing_columns(spark):
    """Null and repeated ids, repeated rows, a very long text, and columns named as those inside."""
    long = " ".join(f"w{k % 20011}" for k in range(60_000))
    rows = [(None, f"null number {k} a b c d e f") for k in range(30)] + [(5, "one two three four five six")] * 40 + [(5, "other words under the same id here"), (6, "ONE two three\tfour five six"), (7, long), (8, long + " end"), (9, None), (10, "  ")]
    schema = "doc_id bigint, text string, id string, node bigint, hash string, lost_id bigint, component_id int, row int"
    df = spark.createDataFrame([(*r, "x", 1, "h", 2, 3, 4) for r in rows], schema)
    got = minhash.near_dups(df).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add((x.component_id, x.kept))
    assert by[5] == {(5, True)} and by[6] == {(5, False)} and by[8] == {(7, False)} and by[9] == {(9, True)} and by[10] == {(10, True)}
    kept = minhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.where("doc_id > 5").collect()) == [7, 9, 10] and kept.where("doc_id is null").count() == 30


def test_language_model_learns_from_every_document(spark):
    """Any few texts train the weights, and all words count."""
    # one text at a time, so that no choice by the text's hash can find them all
    for text in ("a b c d " * 30, "e f g h " * 30, "i j k l " * 30):
        frequent, flat = lm_score.fit(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))[:2]
        net = lm_score.Network(flat)
        own = np.array(lm_score.Classes(frequent).of(text))
        start = lm_score.Network.initial(np.bincount(own, minlength=lm_score.CLASSES))
        # a word seen 30 times in 120, as smoothed over all classes
        group, member = np.divmod(own, lm_score.MEMBERS)
        assert (net.groups[-1, group] + net.members[group, -1, member]).min() > np.log(30 / (120 + lm_score.CLASSES)) and not np.allclose(net.members[:, :-1], start.members[:, :-1])


@pytest.mark.parametrize("share", [1e-6, 0.004])
def test_language_model_tells_words_of_a_class_apart(spark, monkeypatch, share):
    """A word's score has log P(word | class), of held words, joined ones and unseen ones."""
    monkeypatch.setattr(lm_score, "KNOWN_SHARE", share)
    top = " ".join(f"top{i} " * 9 for i in range(lm_score.FREQUENT))
    texts = [top, "seldom " * 6, "rare rare", "once", " ".join(f"x{i}" for i in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = lm_score.fit(df)
    asked = ["top1", "seldom", "rare", "once", "never", "seldom rare rare"]
    got = {r.doc_id: r.log_likelihood for r in lm_score.score(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), model).collect()}
    counts = {w: " ".join(texts).encode().split().count(w) for w in set(" ".join(texts).encode().split())}
    classes, net = lm_score.Classes(model[0]), lm_score.Network(model[1])
    of = {}
    for w, n in counts.items():
        of[classes[w]] = of.get(classes[w], 0) + n
    for i, text in enumerate(asked):
        own = np.array(classes.of(text), np.int64)
        want = net.log_probabilities(lm_score.Network.contexts(own), own).sum()
        want += sum(np.log(counts.get(w, 1) / (of.get(classes[w], 0) + 1)) for w in text.encode().split() if classes[w] >= lm_score.FREQUENT)
        assert got[i] == pytest.approx(want, rel=1e-6)


def test_language_model_is_the_same_for_any_partitions(spark, monkeypatch):
    """Scores, on many shards, of the same rows in one and in many partitions and in another order."""
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 500)
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{min(r.geometric(0.05), 400)}" for _ in range(r.integers(0, 90)))) for i in range(120)] + [(None, "null id here"), (3, None)]
    got = []
    for parts, order in ((1, rows), (7, rows[::-1])):
        df = spark.createDataFrame(order, "doc_id bigint, text string").repartition(parts)
        got.append({(x.doc_id, x.n_tokens): x.log_likelihood for x in lm_score.score(df, lm_score.fit(df)).collect()})
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k], rel=1e-5, abs=1e-9) for k in got[0])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm_score.score(empty, lm_score.fit(empty)).count() == 0


def test_language_model_step_follows_the_gradient():
    """A step's change against finite differences of the mean negative log-probability."""
    r = np.random.default_rng(3)
    tokens = r.integers(0, lm_score.CLASSES, 40)
    around = lm_score.Network.contexts(tokens)
    start = lm_score.Network(r.normal(0, 0.3, lm_score.Network.SIZE))
    moved = lm_score.Network(start.flat)
    moved.step(around, tokens, 1.0)
    loss = lambda flat: -lm_score.Network(flat).log_probabilities(around, tokens).mean()
    for k in np.argsort(-abs(moved.flat - start.flat))[:60:3]:
        up, down = start.flat.copy(), start.flat.copy()
        up[k] += 0.01
        down[k] -= 0.01
        assert start.flat[k] - moved.flat[k] == pytest.approx((loss(up) - loss(down)) / 0.02, rel=0.05, abs=1e-3)


def test_language_model_sums_to_one():
    """Probabilities over all classes, also where logits are too large for a plain exponential."""
    r = np.random.default_rng(4)
    for scale in (0.3, 30.0):
        net = lm_score.Network(r.normal(0, scale, lm_score.Network.SIZE))
        around = np.repeat(r.integers(0, lm_score.CLASSES + 1, (1, 2 * lm_score.SIDE)), lm_score.CLASSES, 0)
        assert np.exp(net.log_probabilities(around, np.arange(lm_score.CLASSES))).sum() == pytest.approx(1, rel=1e-4)


def test_spelled_emails_are_proposed_in_any_case():
    for text in ("jane (AT) example.com", "jane [ at ] example.org", "jane at example Dot com"):
        assert [k for k, *_ in pii.candidates(text)] == ["email_spelled"]
    r = np.random.default_rng(6)
    parts = ["at", "AT", " ", " ", "(", ")", "[", "]", ".", "dot", "jane", "x", "a" * 45, "com", "-"]
    for _ in range(3000):
        text = "".join(r.choice(parts, 25))
        assert list(pii._spelled(text)) == [m.span() for m in re.finditer(pii.SPELLED, text, re.IGNORECASE)]
