"""What a text shouldn't hold before it is published: local paths, credentials and personal addresses.

One pass in the JVM: a literal that each match of a rule has to hold is looked for before the rule's pattern,
on the whole text before it is cut into lines and on the line before the pattern. Patterns use only what both
Java's and RE2's syntax have. A line has one finding of a family at most, of its first rule that matches.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Family, rule, literals of which a match holds one (in lower case), pattern.
RULES = (
    ("path", "windows-drive-path", (":\\", ":/"), r"(?:^|[^A-Za-z0-9])[A-Za-z]:[\\/](?:[^/]|$)"),
    ("path", "windows-unc-path", ("\\\\",), r"\\\\[A-Za-z0-9_.$-]{2,}\\[A-Za-z0-9_.$-]{2,}"),
    ("path", "posix-home-path", ("/home/", "/users/", "/root/", "~/"), r"(?:^|[\s\"'(=])(?:/home/|/Users/|/root/|~/)"),
    ("path", "home-environment-variable", ("%userprofile%", "%appdata%", "$home"), r"(?i)%USERPROFILE%|%APPDATA%|\$HOME\b"),
    ("secret", "private-key-header", ("private key-----",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    (
        "secret",
        "cloud-credential-prefix",
        ("akia", "asia", "gh", "sk-", "xox", "aiza"),
        r"\b(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9]{32,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})\b",
    ),
    ("secret", "credential-bearing-url", ("://",), r"\b[A-Za-z][A-Za-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@"),
)
#: Names whose quoted values are credentials, what is no credential, addresses of nobody, and the least length.
ASSIGNED = r"(?i)\b(?:api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?secret|secret|token|password|passwd|private[_-]?key)\b\s*[:=]\s*(?:'([^']*)'|\"([^\"]*)\")"
ASSIGNED_LITERALS = ("key", "secret", "token", "passw")
PLACEHOLDER = r"(?i)^(?:<.*>|\$\{?[A-Za-z0-9_]+\}?|%[A-Za-z0-9_]+%|[A-Z][A-Z0-9_]{2,}|.*(?:redact|placeholder|example|dummy|fake|changeme|todo|none|null|xxx).*)$"
LEAST_SECRET = 8
EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
NOBODY = r"(?i)(?:users\.noreply\.github\.com|noreply\.github\.com|example\.com|example\.org|example\.net|localhost)$"


def _holds(text: Column, literals: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds one of the literals."""
    return reduce(or_, (F.contains(text, F.lit(x)) for x in literals))


def _family(line: Column, lower: Column, family: str) -> Column:
    """Name of the family's first rule that matches, or null."""
    rules = [(name, literals, pattern) for kind, name, literals, pattern in RULES if kind == family]
    return F.coalesce(*[F.when(_holds(lower, literals) & F.coalesce(F.regexp_like(line, F.lit(pattern)), F.lit(False)), F.lit(name)) for name, literals, pattern in rules])


def _assignment(line: Column, lower: Column) -> Column:
    """Whether the first sensitive name that is given a quoted value is given a credential."""
    value = F.trim(F.concat(F.regexp_extract(line, ASSIGNED, 1), F.regexp_extract(line, ASSIGNED, 2)))
    found = (F.length(value) >= LEAST_SECRET) & ~F.regexp_like(value, F.lit(PLACEHOLDER))
    return F.when(_holds(lower, ASSIGNED_LITERALS) & found, F.lit("hardcoded-credential-assignment"))


def _address(line: Column) -> Column:
    """Whether the line has an address of somebody."""
    addresses = F.filter(F.regexp_extract_all(line, F.lit(EMAIL), F.lit(0)), lambda a: ~F.regexp_like(a, F.lit(NOBODY)))
    return F.when(F.contains(line, F.lit("@")) & (F.size(addresses) > 0), F.lit("personal-identifier-email"))


def find(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id_col, line, rule) of every finding; lines count from 1. Null texts have none."""
    every = tuple(sorted({x for _, _, literals, _ in RULES for x in literals} | {*ASSIGNED_LITERALS, "@"}))
    texts = df.select(id_col, F.col(text_col).cast("string").alias("_text")).where(_holds(F.lower("_text"), every))
    lines = texts.select(id_col, F.posexplode(F.split("_text", "\n")).alias("_at", "_line")).withColumn("_lower", F.lower("_line")).where(_holds(F.col("_lower"), every))
    line, lower = F.col("_line"), F.col("_lower")
    rules = F.array_compact(F.array(_family(line, lower, "path"), _family(line, lower, "secret"), _assignment(line, lower), _address(line)))
    return lines.select(id_col, (F.col("_at") + 1).alias("line"), F.explode(rules).alias("rule"))


def summary(found: DataFrame, *, id_col: str) -> DataFrame:
    """(rule, n, n_texts): findings of each rule, and texts that have one."""
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("n_texts"))


def redact_address(address: Column) -> Column:
    """An address with its local part masked but for the first letters, and its domain."""
    local = F.substring_index(address, "@", 1)
    kept = F.when(F.length(local) > 3, F.substring(local, 1, 3)).otherwise(F.substring(local, 1, 1))
    return F.concat(kept, F.lit("***@"), F.substring(address, F.length(local) + 2, F.length(address)))
