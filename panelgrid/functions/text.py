"""Text and digest columns, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space but the line feed.
SPACES = r"[ \t\x0B\f\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def tidy(text: Column) -> Column:
    """One kind of line end, no NUL, no white space at the ends of lines, and one empty line where there were more."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\x00", "")
    return F.regexp_replace(F.regexp_replace(lines, SPACES + r"+(\n|\z)", "$1"), "\n{3,}", "\n\n")


def safe_stem(name: Column) -> Column:
    """A name for a file: other characters than letters, digits, dots, hyphens and CJK become one underscore; "document" if none is left."""
    cleaned = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z\x{4e00}-\x{9fff}._-]+", "_"), "^_+|_+$", "")
    return F.when(cleaned == "", "document").otherwise(cleaned)


def human_size(n: Column) -> Column:
    """Bytes in the largest unit up to GB of which there is one."""
    size = n.cast("double")
    scaled = lambda power, unit: F.format_string(f"%.1f {unit}", size / 1024.0**power)
    return F.when(n.isNull(), None).when(size < 1024, F.format_string("%d B", n.cast("bigint"))).when(size < 1024**2, scaled(1, "KB")).when(size < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def digests(content: Column) -> Column:
    """The content's SHA-256 and MD5."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"))
