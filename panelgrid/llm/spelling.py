"""Spelling variants of words by a rare-first q-gram prefix filter.

Words are counted in the JVM with partial aggregates. Two words are near if exactly one code point
is inserted, deleted or replaced between them. One such edit destroys at most two of a word's
bigrams, so with bigrams in one global order (rarest in the vocabulary first, then by position) near
words share one of the three rarest of each, at the same position or, in the longer word, one later.
Only those three of each word are joined, by length, bigram and position; as an edit also leaves the
shorter word's first or second half whole, each key carries one of the halves, which splits groups of
words that share a frequent bigram. Every joined pair is verified by its edit distance, so nothing
is missed and nothing wrong is kept.

A form is the near word of largest count (ties: the smallest in code-point order), if that is twice the
word's at least; roots follow forms to their end by pointer doubling, so the number of turns is
the logarithm of a chain's length, itself at most the logarithm of the largest count.

Null texts have no words; a null id counts as an empty one where damage is decided; rows that repeat count
each for itself; an empty table gives no words; texts are read whole, of any length; other columns
are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, settled

#: What separates runs of letters, and the letters of lower-cased runs.
BREAKS = "[^A-Za-zÀ-ÿ]+"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LEAST_LENGTH, LEAST_COUNT, DAMAGED_MOD = 5, 3, 97
PREFIX = 3


def damaged(id_col: str, run: Column) -> Column:
    """The run without one of its code points if DAMAGED_MOD divides the checksum of its id and itself."""
    checksum = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (checksum % F.greatest(F.length(run), F.lit(1))).cast("int")
    return F.when(checksum % DAMAGED_MOD == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least LEAST_LENGTH code points that occur LEAST_COUNT times."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.split(ascii_lower(F.col(text_col).cast("string")), BREAKS)).alias("run"))
    # a deletion only shortens
    words = runs.where(F.length("run") >= LEAST_LENGTH).select(damaged("id", F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letter(word: Column, at: Column) -> Column:
    """Number of the letter at a place (from 1) in LETTERS."""
    code = F.ascii(F.substring(word, at, F.lit(1)))
    return F.when(code < 0xC0, code - ord("a")).otherwise(code - 0xC0 + 26)


def _bigram(word: Column, at: Column) -> Column:
    return _letter(word, at) * len(LETTERS) + _letter(word, at + 1)


def _positions(word: Column) -> Column:
    return F.sequence(F.lit(1), F.length(word) - 1)


def rarest(words: DataFrame) -> DataFrame:
    """Adds rare: the (rank, at) of the PREFIX rarest bigrams of word, at from 1. There are at most
    len(LETTERS) ** 2 = 8,100 bigrams, whatever the table; only their ranks come to the driver."""
    counted = words.select(F.explode(F.transform(_positions(F.col("word")), lambda at: _bigram(F.col("word"), at))).alias("bigram")).groupBy("bigram").count().collect()
    ranks = [0] * len(LETTERS) ** 2
    for rank, (bigram, _) in enumerate(sorted(counted, key=lambda r: (r[1], r[0]))):
        ranks[bigram] = rank
    order = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<int>")
    found = F.transform(_positions(F.col("word")), lambda at: F.struct(F.get(order, _bigram(F.col("word"), at)).alias("rank"), at.alias("at")))
    return words.withColumn("rare", F.slice(F.array_sort(found), 1, PREFIX))


def near_pairs(words: DataFrame) -> DataFrame:
    """words: (word, n). Returns (word, n, near, near_n) once for each unordered pair of near words;
    word is the shorter of both or the smaller of equal length."""
    word, size = F.col("word"), F.length("word")
    grams = rarest(words).select("word", "n", F.explode("rare").alias("rare"))

    def key(length: Column, at: Column, part: int) -> Column:
        """Of a word of that length, or of one that becomes so by losing one letter of the other part."""
        first = F.floor(length / 2).cast("int")
        half = F.substring(word, F.lit(1), first) if part == 0 else F.substring(word, size - length + first + 1, length - first)
        return F.xxhash64(length, F.lit(part), half, F.col("rare.rank"), at)

    at = F.col("rare.at")
    own = F.array(*(key(size, at, part) for part in (0, 1)))
    # of a longer word a bigram of the whole first half stays in its place; others may move up by one
    longer = F.array(*(key(size - 1, at - back, part) for part in (0, 1) for back in (0, 1)))
    left = grams.select(F.explode(own).alias("key"), "word", "n")
    right = grams.select(F.explode(F.concat(own, longer)).alias("key"), word.alias("near"), F.col("n").alias("near_n"))
    ordered = (F.length("near") > F.length("word")) | ((F.length("near") == F.length("word")) & (F.col("word") < F.col("near")))
    return left.join(right, "key").where(ordered & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n").distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Returns per word n, n_near, form and form_n."""
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    best = F.min(F.when(F.col("near_n") >= 2 * F.col("n"), F.struct((-F.col("near_n")).alias("less"), "near")))
    each = pairs.unionByName(back).unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    return each.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """linked: (word, form), none null. Returns (word, root), root the end of each word's chain of forms."""
    at = scratch.write(linked.select("word", F.col("form").alias("root")))
    while at.join(at.select(F.col("word").alias("root")), "root", "left_semi").limit(1).count():
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, at = at, scratch.write(at.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        scratch.drop(last)
    return at


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns per word (word, form, root, n, n_near, form_n); see the module."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(word_counts(docs, id_col=id_col, text_col=text_col))
    each = settled(forms(words, near_pairs(words)))
    scratch.drop(words)
    ends = roots(each.where("form is not null"), scratch)
    out = each.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
