"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, html_text, license_scan, lm_score, minhash, packing, pii, quality, spelling, url_filter, vector_codes
from .common import table

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = os.environ.get("PANELGRID_TOKENIZERS", "/opt/tokenizers")

#: The pre-token pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Of the labelled rows, those with this remainder of crc32(doc_id) are held out.
HELD_OUT_MOD = 5
QUALITY_LEAST = 0.3


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", PATTERN, digest=True)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)))
    base = F.filter("spans", lambda x: x.kind.isin(*pii.BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Pieces by the vocabulary and special tokens of byte_bpe_50k."""
    return packing.pieces(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN, specials=packing.special_tokens(f"{TOKENIZERS}/byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packed_pieces(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


def held_out() -> F.Column:
    """Whether a row of doc_id is held out of training."""
    return F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_MOD == 0


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), where=~held_out())
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dups(table(spark, sf_dir, "documents"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda x: x.base)
    starts = F.transform(base, lambda x: x.start)
    labels = lambda places: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda x: x.label))))
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_pii, op4_embedding_dedup, op5_url_filter, op6_packing, op7_lm_score, op8_quality, op9_minhash, op10_license, op11_html_text, op12_spelling, op13_vector_codes)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (norm)
"""

_URLS = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, r_host, r_path) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/'))
SELECT page_id, host, path, (x).rule AS rule, coalesce((x).verdict, 'allow') AS verdict FROM (
  SELECT page_id, host, path,
    (SELECT max_by({'rule': r_host || r_path, 'verdict': r.verdict}, length(r_host || r_path)) FROM r
     WHERE (u.host = r_host OR ends_with(u.host, '.' || r_host)) AND starts_with(u.path, r_path)) AS x
  FROM u)
"""


#: Letters beyond a-z as one byte each, so that byte and code-point distances agree.
_ONE_BYTE = ("".join(map(chr, range(0xC0, 0x100))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~"[:64])

_SPELLING = rf"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY 1, 2),
hashed AS (
  SELECT run, times, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [192 + (unicode(s)::BIGINT >> 6), 128 + (unicode(s)::BIGINT & 63)] END)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM runs, crc),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n, translate(word, '{_ONE_BYTE[0]}', '{_ONE_BYTE[1]}') AS w FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS (SELECT word, n, w, unnest(list_distinct(list_append(list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1)), w))) AS v FROM words),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (v) WHERE a.w <> b.w AND levenshtein(a.w, b.w) = 1),
forms AS (
  SELECT word, count(*) AS n_near, min(CASE WHEN near_n >= 2 * n THEN {{'less': -near_n, 'near': near}} END) AS best FROM near GROUP BY word),
each AS (SELECT word, n, coalesce(n_near, 0) AS n_near, best.near AS form, -best.less AS form_n FROM words LEFT JOIN forms USING (word)),
chain AS (
  SELECT word, word AS root FROM each
  UNION ALL SELECT chain.word, each.form FROM chain JOIN each ON each.word = chain.root WHERE each.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN each ON each.word = chain.root WHERE each.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM each JOIN ends USING (word)
"""


def _codes_sql() -> str:
    """Every round of the codebooks as two steps: parts assigned to entries, entries moved."""
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (
  SELECT vec_id, label, s.p, min({{'d': list_sum(list_transform(list_zip(s.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.e}}) AS x
  FROM parts s JOIN c{k} c ON s.p = c.p GROUP BY vec_id, label, s.p)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""
m{k} AS (
  SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT d.p, x.e AS e, i, CAST(sum(s.v[i]) AS BIGINT) AS total, count(*) AS n
    FROM d{k} d JOIN parts s USING (vec_id, p), range(1, len(s.v) + 1) r(i) GROUP BY 1, 2, 3) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    last = vector_codes.ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS v FROM kept, range(16) r(p)),
c0 AS MATERIALIZED (
  SELECT p, e, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{",".join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', x.e), '' ORDER BY p) AS code, CAST(sum(x.d) AS BIGINT) AS error FROM d{last} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{last}, range(1, len(v) + 1) r(i)) AS codebooks_sha256
FROM coded
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _EXACT, "op5_url_filter": _URLS, "op12_spelling": _SPELLING, "op13_vector_codes": _codes_sql()}
