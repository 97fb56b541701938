"""Best-fit packing of documents into sequences, bulk-synchronously.

A document is its ids and a final id; only longer ones than a sequence are cut, the first piece
taking the remainder. Pieces are packed by bands of length, longest first. A round of a band

1. offers its slots: a gap that has room for several pieces of the band is as many slots, though all gaps
   together about twice as many as pieces wait, as the rest would stay free in any case;
2. sorts waiting pieces and slots together by length, by ranges over all tasks, equal lengths by their
   numbers, so that a length of which there are very many is dealt over many tasks;
3. sweeps: each task goes through its range upwards and gives each slot its predecessor, the longest
   piece before it that still waits (so a piece gets the successor of its length among the slots not
   taken by pieces between them), and what a task can't match, pieces that wait for longer slots than
   it has and slots without a piece, is matched across tasks by rank: the sweep's leftovers of each
   task are counted, and the r-th slot left in one task meets the r-th piece from the end of another;
4. updates the gaps.

Rounds of a band repeat; after one that matches nothing the pieces that still wait are ranked through
all tasks and the longest open new sequences. When none waits the next band follows. The driver sees a
few counts for each task and round, never a piece or a gap.

Null counts as empty text, which is one piece of the final id alone; repeated rows are packed each; an
empty table gives an empty result. Texts of any length are read whole; other columns aren't read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import CodecSource
from .common import Scratch, small_table

CAPACITY, END_ID = 1024, 2
#: Pieces and slots that a task sweeps.
ROWS_EACH = 100_000


def pieces(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, specials: dict[str, int] | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row, and with_ids the ids. specials: strings that
    are one id each wherever they stand in a text."""
    source, specials = CodecSource(df.sparkSession, ranks_path, pattern), specials or {}
    split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = source()
        for b in batches:
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                if text and specials and split.search(text):
                    ids_of = [x for part in split.split(text) for x in ([specials[part]] if part in specials else codec.encode_whole(part))]
                else:
                    ids_of = codec.encode_whole(text)
                own = np.array([*ids_of, end_id], "<u4")
                first = len(own) % capacity or capacity
                for k, s in enumerate([0, *range(first, len(own), capacity)]):
                    part = own[s : first if k == 0 else s + capacity]
                    of.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype("i4"))
            cols = [b.column("id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


def special_tokens(path: str) -> dict[str, int]:
    """The special tokens of a tokenizer's JSON file, with their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}


def bands(capacity: int) -> list[tuple[int, int]]:
    """(most, least + 1) lengths of each band, longest first: of which 1, 2, ... 8 fit a sequence, then halves."""
    tops = [capacity // k for k in range(1, 9)]
    while tops[-1] > 1:
        tops.append(tops[-1] // 2)
    tops = sorted({t for t in tops if t > 0}, reverse=True)
    return list(zip(tops, [*tops[1:], 0], strict=True))


PIECE, SLOT = 0, 1
_SWEPT = "row bigint, length bigint, sequence bigint, slot int, part int, rank bigint"


def _sweep(batches: Iterator) -> Iterator:
    """Of rows (size, kind, row, sequence, slot) in the order of size: matches (row and sequence), waiting
    pieces (row alone) and slots left (sequence alone), the latter two ranked upwards within the task."""
    import pyarrow as pa

    columns = [np.zeros(0, np.int64)] * 5
    for b in batches:
        columns = [np.concatenate([c, b.column(x).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)]) for c, x in zip(columns, ("size", "kind", "row", "sequence", "slot"), strict=True)]
    size, kind, row, sequence, slot = columns
    waiting, pairs, left = [], [], []
    for k, is_slot in enumerate((kind == SLOT).tolist()):
        if not is_slot:
            waiting.append(k)
        elif waiting:
            pairs.append((waiting.pop(), k))
        else:
            left.append(k)
    piece, at = np.array(pairs, np.int64).reshape(-1, 2).T
    waiting, left = np.array(waiting, np.int64), np.array(left, np.int64)
    none = lambda x: np.full(len(x), -1)
    out = [
        np.concatenate([row[piece], row[waiting], none(left)]),
        np.concatenate([size[piece], size[waiting], none(left)]),
        np.concatenate([sequence[at], none(waiting), sequence[left]]),
        np.concatenate([slot[at], none(waiting), slot[left]]),
        np.full(len(piece) + len(waiting) + len(left), TaskContext.get().partitionId()),
        np.concatenate([none(piece), np.arange(len(waiting)), np.arange(len(left))]),
    ]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(x, t, mask=x < 0) for x, t in zip(out, types, strict=True)], names=["row", "length", "sequence", "slot", "part", "rank"])


def _across(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Segments (piece_part, last_rank, slot_part, first_rank, n) of what tasks leave each other. counts:
    of each task the waiting pieces and the slots left; a slot takes the longest piece of the tasks before its own."""
    stack, out = [], []
    for part in sorted(counts):
        pieces, slots = counts[part]
        taken = 0
        while taken < slots and stack:
            of, waiting = stack.pop()
            n = min(waiting, slots - taken)
            out.append((of, waiting - 1, part, taken, n))
            taken += n
            if waiting > n:
                stack.append((of, waiting - n))
        if pieces:
            stack.append((part, pieces))
    return out


def _tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS_EACH))


_SEGMENT = "piece_part int, last_rank bigint, slot_part int, first_rank bigint, n bigint"


def pack(parts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(...)."""
    spark = parts.sparkSession
    scratch, keep = Scratch(spark), parts.columns
    # numbered once and written, so that a task that runs again doesn't number them anew
    parts = scratch.write(parts.withColumn("row", F.monotonically_increasing_id()))
    rounds, gaps, opened, number, last = [], None, 0, 0, None
    present = {int(r.length): int(r.n) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity
    for most, least in bands(capacity):
        total = sum(n for length, n in present.items() if least < length <= most)
        if not total:
            continue
        waiting = parts.where((F.col("length") > least) & (F.col("length") <= most)).select("row", "length")
        while True:
            sized = waiting.select(F.col("length").alias("size"), F.lit(PIECE).alias("kind"), "row", F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("int").alias("slot"))
            offering = 0
            if gaps is not None:
                offering = gaps.where(F.col("free") > least).count()
                slots = F.greatest(F.lit(1), F.least(F.lit(2 * total // max(1, offering)), F.floor(F.col("free") / most))).cast("int")
                offered = gaps.where(F.col("free") > least).select(F.floor(F.col("free") / slots).alias("size"), F.lit(SLOT).alias("kind"), F.lit(None).cast("bigint").alias("row"), "sequence", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
                sized = sized.unionByName(offered)
            tasks, pairs = _tasks(3 * total + offering), _tasks(total)  # of no more pieces and slots than that
            swept = scratch.write(sized.repartitionByRange(tasks, "size", "kind", "row", "sequence", "slot").sortWithinPartitions("size", "kind", "row", "sequence", "slot").mapInArrow(_sweep, _SWEPT), tasks)
            scratch.drop(last)
            last = swept
            # two counts for each task
            alone, free = F.col("sequence").isNull(), F.col("row").isNull()
            counted = swept.groupBy("part").agg(F.count_if(alone).alias("p"), F.count_if(free).alias("s"), F.count_if(~alone & ~free).alias("m")).collect()
            segments = _across({r.part: (r.p, r.s) for r in counted})
            matched = swept.where(~alone & ~free).select("row", "length", "sequence", "slot")
            left = swept.where(alone).select("row", "length", "part", "rank")
            if segments:
                of = F.broadcast(small_table(spark, segments, _SEGMENT))  # at most two for each task
                met = left.join(of, (F.col("part") == F.col("piece_part")) & (F.col("rank") <= F.col("last_rank")) & (F.col("rank") > F.col("last_rank") - F.col("n")))
                met = met.select("row", "length", F.col("slot_part").alias("part"), (F.col("first_rank") + F.col("last_rank") - F.col("rank")).alias("rank"))
                matched = matched.unionByName(met.join(swept.where(free).select("sequence", "slot", "part", "rank"), ["part", "rank"]).select("row", "length", "sequence", "slot"))
                # of each task the pieces below the last segment's wait on
                lowest = {}
                for part, last_rank, _, _, n in segments:
                    lowest[part] = min(lowest.get(part, last_rank + 1), last_rank - n + 1)
                rest = F.broadcast(small_table(spark, list(lowest.items()), "part int, below bigint"))
                left = left.join(rest, "part", "left").where("below is null or rank < below").drop("below")
            else:
                lowest = {}
            found = sum(r.m for r in counted) + sum(s[4] for s in segments)
            if found:
                matched = scratch.write(matched.withColumn("round", F.lit(number)), pairs)
                number += 1
                rounds.append(matched)
                took = matched.groupBy("sequence").agg(F.sum("length").alias("took"))
                old, gaps = gaps, scratch.write(gaps.join(took, "sequence", "left").select("sequence", (F.col("free") - F.coalesce("took", F.lit(0))).alias("free")).where("free > 0"), _tasks(opened))
                scratch.drop(old)
            before, total = {}, 0
            for r in sorted(counted, key=lambda r: r.part):
                before[r.part], total = total, total + min(r.p, lowest.get(r.part, r.p))
            if not total:
                break
            waiting = left.select("row", "length")
            if found:
                continue
            # no slot fits any piece that waits: ranked through all tasks, the longest open new sequences,
            # `each` to one; where more than `each` may fit, only as many as their tokens need at least
            each = capacity // most
            new = -(-total // each)
            if (least + 1) * (each + 1) <= capacity:
                new = min(new, -(-left.agg(F.sum("length")).first()[0] // capacity))
            ranks = F.broadcast(small_table(spark, list(before.items()), "part int, before bigint"))
            ranked = left.join(ranks, "part").withColumn("place", F.lit(total - 1) - F.col("before") - F.col("rank"))
            placing = F.col("place") < new * each
            at = (F.lit(opened) + F.floor(F.col("place") / each)).alias("sequence"), (F.col("place") % each).cast("int").alias("slot")
            matched = scratch.write(ranked.where(placing).select("row", "length", *at, F.lit(number).alias("round")), pairs)
            number, opened = number + 1, opened + new
            rounds.append(matched)
            made = matched.groupBy("sequence").agg((capacity - F.sum("length")).alias("free")).where("free > 0")
            old, gaps = gaps, scratch.write(made if gaps is None else gaps.unionByName(made), _tasks(opened))
            scratch.drop(old)
            if total <= new * each:
                break
            waiting = ranked.where(~placing).select("row", "length")
    placed = rounds[0] if rounds else small_table(spark, [], "row bigint, length bigint, sequence bigint, slot int, round int")
    for r in rounds[1:]:
        placed = placed.unionByName(r)
    # at most capacity pieces to a sequence
    order = Window.partitionBy("sequence").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = scratch.write(placed.select("row", F.col("sequence").alias("sequence_id"), (F.sum("length").over(order) - F.col("length")).alias("offset")))
    scratch.drop(last, gaps, *rounds)  # what the result reads stays: the pieces and their places
    return parts.join(placed, "row").select(*keep, "sequence_id", "offset")
