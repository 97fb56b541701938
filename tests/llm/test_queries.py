"""The registered queries, over whole tables, against brute-force versions of their contracts."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from panelgrid.llm import lm_score, pii
from panelgrid.llm import queries as q

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in rows(spark, "documents")}


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_components(texts):
    """doc_id -> (size of its set, least id that it reaches); pairs are counted by an index of shingles."""
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    holders, links = defaultdict(list), []
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        links += [(j, k) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
        for x in s:
            holders[x].append(k)
    return {i: (len(s), ids[r]) for i, s, r in zip(ids, sets, roots(len(ids), links), strict=True)}


def base_spans(text):
    """The base kinds' spans by their patterns."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(s):
        d = digits(s)[::-1]
        return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_op1(spark, texts):
    import tiktoken

    with open(f"{q.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=q.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op1_bpe(spark, FOLDER).collect()}
    want = {i: enc.encode_ordinary(t) for i, t in texts.items()}
    assert got == {i: (len(ids), sha(",".join(map(str, ids))), sha(texts[i])) for i, ids in want.items()}


def test_op2(spark, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t.translate(LOWER)].append(i)
    want = {(i, max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}
    got = q.op2_exact_dedup(spark, FOLDER).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == len(texts) and {tuple(r) for r in got} == want


def test_op3(spark, texts):
    got = {r.doc_id: r for r in q.op3_pii(spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = base_spans(t)
        line = [f"{k}:{a}:{b}" for k, a, b in base]
        counts = Counter(k for k, _, _ in base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(counts[k] for k in pii.BASE_KINDS)
        assert got[i].base_sha256 == sha(",".join(line)) and set(line) <= set(got[i].spans.split(","))


def test_op4(spark):
    vectors = {r.vec_id: r.embedding for r in rows(spark, "embeddings")}
    ids = sorted(vectors)
    sound = [i for i in ids if vectors[i] and None not in vectors[i] and np.isfinite(vectors[i]).all() and any(vectors[i])]
    unit = np.array([vectors[i] for i in sound], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    at = {i: k for k, i in enumerate(ids)}
    links = [(at[sound[a]], at[sound[b]]) for a, b in np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))]
    count = Counter(x for pair in links for x in pair)
    want = {(ids[k], count[k], ids[r], k == r) for k, r in enumerate(roots(len(ids), links))}
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in q.op4_embedding_dedup(spark, FOLDER).collect()} == want


def test_op5(spark):
    want = set()
    for r in rows(spark, "pages"):
        host = path = ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOWER)
        fit = [(len(h + p), h + p, v) for v, h, p in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        want.add((r.page_id, host, path, rule, verdict))
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in q.op5_url_filter(spark, FOLDER).collect()} == want


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{q.TOKENIZERS}/byte_bpe_50k.json")
    want = set()
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    got = q.op6_packing(spark, FOLDER).collect()
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want
    check_sequences(got)


def check_sequences(got):
    """No gap, no overlap, none too long; and hardly more sequences than the tokens need."""
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024
    lengths = sorted((r.length for r in got), reverse=True)
    free = []
    for n in lengths:  # best fit decreasing, one piece at a time
        at = min((k for k, f in enumerate(free) if f >= n), key=free.__getitem__, default=None)
        if at is None:
            free.append(1024 - n)
        else:
            free[at] -= n
    assert len(places) <= len(free)


def test_op7(spark, texts):
    got = q.op7_lm_score(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == texts.keys() and len(got) == len(texts)
    docs = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).permutation(t.split()))) for i, t in texts.items()], "doc_id bigint, text string")
    model = lm_score.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    a, b = (sum(r.log_likelihood for r in rs) / sum(r.n_tokens for r in rs) for rs in (got, lm_score.score(docs, model).collect()))
    assert a > b  # texts are likelier than their shuffled words


def test_op8(spark, texts):
    got = {r.doc_id: r for r in q.op8_quality(spark, FOLDER).collect()}
    assert got.keys() == texts.keys() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_op8_held_out_accuracy(spark):
    """At sf0.01: the smaller tables hold out 19 labels only (17 of them right), too few to tell 0.9 from chance."""
    folder = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in q.op8_quality(spark, folder).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out}
    assert np.mean([got[i].predicted == m for i, m in marks.items()]) >= 0.9


def test_op9(spark, texts):
    got = q.op9_minhash(spark, FOLDER).collect()
    assert len(got) == len(texts) and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components(texts)


def test_op10(spark, texts):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    got = {r.doc_id: r for r in q.op10_license(spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        found = [(k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p)] == p]
        starts = [k for k, _ in found]
        r, labels = got[i], sorted({label for _, label in found})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_pipeline(spark, texts):
    """Every stage's decision by its brute-force version, on what the stage before keeps."""
    good = {r.doc_id for r in q.op8_quality(spark, FOLDER).collect() if r.predicted}
    last = {texts[i].translate(LOWER): i for i in sorted(good)}
    single = {i: texts[i] for i in last.values()}
    kept = {i for i, (_, c) in near_components(single).items() if c == i}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == kept
    check_sequences(got)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = {r.doc_id: r.text or "" for r in corpus_pipeline.pii_stage(spark, docs.where(docs.doc_id.isin(*kept)), FOLDER).collect()}
    assert not [i for i, t in clean.items() if base_spans(t)] and all(clean[i] == texts[i] for i in kept if not pii_spans(spark)[i])


def pii_spans(spark, held={}):  # noqa: B006
    if not held:
        held |= {r.doc_id: r.spans for r in q.op3_pii(spark, FOLDER).collect()}
    return held
