"""Vector code compression: product codes found by partial-distance search.

Components become integers, vectors are cut into PARTS equal parts, and each part is coded by the
nearest entry of its own codebook. The search takes a part's dimensions in descending variance of
the codebook, adds up squared differences for whole batches at once, and masks out an entry as soon
as its accumulated distance strictly exceeds the best complete distance that the row has so far; so
no entry that is nearest or tied is lost, and ties go to the lower index.

Rounds of refinement are one pass each: a task adds up its own parts per entry, Spark adds up the
tasks' sums, and only ENTRIES x dimension sums come to the driver, whatever the table. Codebooks of
that size are broadcast.

Vectors that are null or hold a null, NaN or infinite component are dropped. A shorter vector than
the longest, and one whose length is no multiple of PARTS, counts as padded with zeros; an empty one
is all zeros. Codebooks start with the smallest ids (nulls last; rows that repeat an id in the
order of their components), fewer than ENTRIES if there are fewer rows. Every row is coded for
itself, repeated or not. An empty table gives no rows; other columns are never read, whatever
their names. Components of 2^19 and more are an error, as their distances would not fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, settled

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries between two updates of the best complete distances.
BLOCK = 16
#: Label groups up to which their sums are broadcast (some 200 KB).
BROADCAST_LABELS = 10_000
_LARGEST = 2**27


def search(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book, and its squared distance, for each of the integer rows."""
    n, width = rows.shape
    order = np.argsort(-book.var(axis=0), kind="stable") if width else []
    at, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not width or not n:
        return at, best
    # a first complete distance: of the entry next in the leading dimension
    lead = order[0]
    by_lead = np.argsort(book[:, lead], kind="stable")
    place = np.clip(np.searchsorted(book[by_lead, lead], rows[:, lead]), 0, len(book) - 1)
    at = by_lead[place]
    best = ((rows - book[at]) ** 2).sum(axis=1)
    for start in range(0, len(book), BLOCK):
        part = book[start : start + BLOCK]
        total = (rows[:, lead, None] - part[None, :, lead]) ** 2
        row, entry = np.nonzero(total <= best[:, None])
        total = total[row, entry]
        for d in order[1:]:
            total = total + (rows[row, d] - part[entry, d]) ** 2
            stays = total <= best[row]
            row, entry, total = row[stays], entry[stays], total[stays]
        if not len(row):
            continue
        # row is sorted, and entry within it: the first of the least totals of each row
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        found, least = row[starts], np.minimum.reduceat(total, starts)
        is_least = total == np.repeat(least, np.diff(np.r_[starts, len(row)]))
        row, entry = row[is_least], entry[is_least] + start
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        entry = entry[first]
        better = (least < best[found]) | (entry < at[found])
        at[found[better]], best[found[better]] = entry[better], least[better]
    return at, best


def _integers(column, width: int) -> np.ndarray:
    """(rows, PARTS * width) of an Arrow column of lists without nulls."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= _LARGEST:
        raise ValueError(f"a component of {_LARGEST // SCALE} or more has no exact code distance")
    out = np.zeros((len(sizes), PARTS * width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64)
    return out


def _first_books(kept: DataFrame, width: int) -> np.ndarray:
    """(PARTS, entries, width) of the smallest ids."""
    import pyarrow as pa

    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    rows = _integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width)
    return rows.reshape(len(rows), PARTS, width).transpose(1, 0, 2)


def _refined(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of the mean of the parts nearest to it, if there are any."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        books = shared.value
        parts, entries, width = books.shape
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            rows = _integers(b.column("vector"), width)
            for p in range(parts):
                own = rows[:, p * width : (p + 1) * width]
                at, _ = search(own, books[p])
                np.add.at(sums[p], at, own)
                counts[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    each = kept.select("vector").mapInArrow(run, "part bigint, entry bigint, n bigint, sums array<bigint>")
    total = each.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    books = books.copy()
    for r in total.collect():
        books[r.part, r.entry, r.at] = r.sum // r.n
    return books


def _coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        books = shared.value
        parts, _, width = books.shape
        for b in batches:
            rows = _integers(b.column("vector"), width)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                codes[:, p], distance = search(rows[:, p * width : (p + 1) * width], books[p])
                error += distance
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    schema = T.StructType([kept.schema["id"], kept.schema["label"]]).add("code", "string").add("error", "long")
    return kept.mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codebooks(kept: DataFrame) -> np.ndarray:
    """kept: (id, vector, ...) of valid vectors. (PARTS, entries, width) after ROUNDS of refinement."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    books = _first_books(kept, -(-longest // PARTS))
    for _ in range(ROUNDS):
        books = _refined(kept, books)
    return books


def vector_codes(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Returns per kept row (id_col, code, error, label_error, codebooks_sha256); see the module."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label")).where(F.col("vector").isNotNull() & finite)
    books = codebooks(kept)
    rows = settled(_coded(kept, books))
    totals = checkpointed(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    small = totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    out = rows.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
