"""URL filtering by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions ``host suffix + path prefix`` of the lengths that rules
have; these are joined to the rules by the first 32 bits of their SHA-256 and confirmed by the full
digest, and the longest rule decides (then the longer host, then block before allow).

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
then up to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty host and path and
fits no rule. A rule fits its host and all subdomains if the path starts with the rule's path.
Repeated rows are returned as often as they occur; an empty table gives an empty result. URLs of any length are read
whole; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules (each some 150 bytes) up to this number are broadcast, more are joined by a shuffle.
BROADCAST_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _prefix(c: Column) -> Column:
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint")


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """rules: host, path, verdict (allow or block; rows with a null are ignored). Returns one row per
    row of pages: id_col, host, path, rule (host + path of the rule that decides, else null), verdict."""
    rules = rules.select(ascii_lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host <> '' and r_path is not null and r_verdict is not null").distinct()
    rules = rules.withColumn("r_sha", F.sha2(F.concat_ws("\0", "r_host", "r_path"), 256)).withColumn("r_prefix", _prefix(F.col("r_sha")))
    # lengths of paths and of hosts in labels: as many as a URL can be long, whatever the number of rules
    shapes = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("r_path")).alias("paths"), F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels")).first()
    lists = {k: F.array(*[F.lit(x) for x in sorted(shapes[k])]).cast("array<int>") for k in ("paths", "labels")}

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    fits = F.filter(lists["labels"], lambda k: k <= F.size(F.split("host", r"\.")))
    suffixes = F.transform(fits, lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(F.filter(lists["paths"], lambda k: k <= F.length("path")), lambda k: F.call_function("substring", F.col("path"), F.lit(1), k))
    each = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\0", h, p), 256))))
    # the null stands for the row itself
    exprs = rows.withColumn("sha", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(each)))).withColumn("prefix", _prefix(F.col("sha")))
    found = exprs.join(F.broadcast(rules) if shapes.n <= broadcast_rules else rules, (F.col("prefix") == F.col("r_prefix")) & (F.col("sha") == F.col("r_sha")), "left").where("sha is null or r_sha is not null")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = found.groupBy("id", "host", "path").agg(F.count_if(F.col("sha").isNull()).alias("copies"), F.max(F.when(F.col("r_sha").isNotNull(), rank)).alias("best"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rules as (verdict, host, path)."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
