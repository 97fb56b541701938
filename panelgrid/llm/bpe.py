"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts are cut into overlapping chunks that are pre-tokenised in parallel; two neighbours are stitched
at the first position of their overlap where both scans have a pre-token boundary, for from there on
both scans agree. The character before a stitch isn't white space, as a run of white space is one
pre-token or two by what follows it, and a boundary close to the end of a chunk that the text goes
beyond isn't used, as a contraction may be cut there. Each chunk then encodes the piece between its
two stitches, which holds whole pre-tokens and ends as the sequential scan ends it, and the ids of the
pieces are put together. A text of one chunk is one piece, encoded where it lies without a shuffle. A
text with an overlap in which the scans never meet (one piece longer than the overlap) is encoded
whole, by one task, so ids are always those of the sequential scan. Decoding concatenates the bytes of
the ids.

Null and empty texts have no ids. Repeated rows and null ids are kept row by row; an empty table gives
an empty result. Other columns, of any name, aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: Distinct space-delimited units a worker remembers, and the longest unit that it remembers.
CACHE_UNITS, CACHE_CHARS = 200_000, 48
#: Boundaries so close to the end of a chunk may be artefacts of the cut.
UNSURE_CHARS = 8


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BpeCodec:
    """Encodes texts as tiktoken's encode_ordinary does, and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self._direct = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = {i: b for b, i in ranks.items()}
        self._units: dict[str, tuple[int, ...] | None] = {}

    def _unit(self, u: str) -> tuple[int, ...] | None:
        """Ids of a unit after a space; None if it isn't bounded by pre-token boundaries."""
        ids = None if not u or u[0].isspace() or u[-1].isspace() else tuple(self._direct(" " + u))
        if len(u) <= CACHE_CHARS:
            if len(self._units) >= CACHE_UNITS:
                self._units.clear()
            self._units[u] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """A single space between other than white space always begins a pre-token, so the units
        between such spaces are encoded apart, and equal units once."""
        if not text:
            return []
        first, *rest = text.split(" ")
        got = self._units
        try:
            ids = [got[u] for u in rest]
        except KeyError:
            ids = [got[u] if u in got else self._unit(u) for u in rest]
        if first and not first[-1].isspace() and None not in ids:
            return [*self._direct(first), *chain.from_iterable(ids)]
        out, held = [], first
        for u in rest:
            if held and u and not held[-1].isspace() and not u[0].isspace():
                out += self._direct(held)
                held = " " + u
            else:
                held = f"{held} {u}"
        return out + self._direct(held)

    def encode_whole(self, text: str | None) -> list[int]:
        """The same ids by one call for the whole text."""
        return self._direct(text) if text else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens of a scan that begins at 0, but for those of white space."""
        return [m.end() for m in self.pattern.finditer(text) if not text[m.end() - 1].isspace()]


class CodecSource:
    """The rank file read once on the driver and broadcast (its size is that of the vocabulary); each worker builds its codec once."""

    _built: dict[str, BpeCodec] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.key, self.pattern = f"{path}\0{pattern}", pattern
        self.ranks = spark.sparkContext.broadcast(load_ranks(path))

    def __call__(self) -> BpeCodec:
        if self.key not in CodecSource._built:
            CodecSource._built[self.key] = BpeCodec(self.ranks.value, self.pattern)
        return CodecSource._built[self.key]


def _mapper(source: CodecSource, key: str, text: str, fn: Callable[[BpeCodec, str | None], tuple], names: list[str], types: list) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = source()
        for b in batches:
            rows = [fn(codec, t) for t in b.column(text).to_pylist()]
            cols = [pa.array([r[i] for r in rows], type=getattr(pa, t)() if isinstance(t, str) else pa.list_(getattr(pa, t[0])())) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(key), *cols], names=[key, *names])

    return run


def _digest(codec: BpeCodec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _pieces(source: CodecSource, fn: Callable[[BpeCodec, list[int]], tuple], keys: list[str], names: list[str], types: list) -> Callable:
    """Encodes pieces: each chunk's text from its own stitch to the next one (null: to its end)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = source()
        for b in batches:
            spans = zip(*(b.column(x).to_pylist() for x in ("start", "part", "cut", "next_cut")), strict=True)
            rows = [fn(codec, codec.encode(part[cut - start : None if after is None else after - start])) for start, part, cut, after in spans]
            cols = [pa.array([r[i] for r in rows], type=getattr(pa, t)() if isinstance(t, str) else pa.list_(getattr(pa, t[0])())) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), *cols], names=[*keys, *names])

    return run


def _stitched(several: DataFrame, source: CodecSource, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Of chunks (row, id, n_chunks, n, start, part): the same with their stitches, and (id, text) of
    the texts in which two scans never meet."""
    stride = chunk - overlap
    # checkpointed, so that row numbers are the same in both passes; dealt by chunk, so that one long text is spread
    several = checkpointed(several.repartition("row", "n"))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = source()
        for b in batches:
            heads, tails = [], []
            for start, part, n, n_chunks in zip(*(b.column(c).to_pylist() for c in ("start", "part", "n", "n_chunks")), strict=True):
                last = n == n_chunks - 1
                ends = [e for e in codec.boundaries(part) if last or e < len(part) - UNSURE_CHARS]
                heads.append([start + e for e in ends if e <= overlap] if n else [])
                tails.append([] if last else [start + e for e in ends if e >= stride])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array(heads, longs), pa.array(tails, longs)], names=["row", "n", "head", "tail"])

    seen = several.select("row", "n", "n_chunks", "start", "part").mapInArrow(scan, "row bigint, n int, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("row").orderBy("n")
    cuts = (
        seen.withColumn("met", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
        .withColumn("cut", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("met")))
        .select("row", "n", "cut", F.lead("cut").over(order).alias("next_cut"), (F.min(F.coalesce("cut", F.lit(-1))).over(Window.partitionBy("row")) >= 0).alias("synced"))
    )
    cut = several.join(cuts, ["row", "n"])
    whole = (
        cut.where("not synced")
        .groupBy("row")
        .agg(F.first("id").alias("id"), F.expr(f"concat_ws('', transform(array_sort(collect_list(struct(n, if(n = n_chunks - 1, part, left(part, {stride})) as p))), x -> x.p))").alias("part"))
    )
    return cut.where("synced").drop("synced"), whole.select("id", "part")


def encode(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Encode every text. Returns (id_col, ids array<int>), or with ``digest`` (id_col, n_tokens,
    ids_sha256, decoded_sha256), where the ids are also decoded again; other columns aren't read."""
    if not UNSURE_CHARS <= overlap_chars < chunk_chars // 2:
        raise ValueError(f"the overlap has to be of {UNSURE_CHARS} characters at least and shorter than half a chunk")
    source = CodecSource(df.sparkSession, ranks_path, pattern)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    starts = F.expr(f"sequence(0L, greatest(0L, cast(char_length(text) as bigint) - {overlap_chars} - 1), {chunk_chars - overlap_chars}L)")
    texts = rows.withColumn("n_chunks", F.when(F.length("text") <= chunk_chars, 1).otherwise(F.size(starts)))
    # a text of one chunk is its only piece
    single = texts.where("n_chunks = 1").select("id", F.lit(0).alias("start"), F.col("text").alias("part"), F.lit(0).alias("cut"), F.lit(None).cast("bigint").alias("next_cut"))
    several = texts.where("n_chunks > 1").withColumn("row", F.monotonically_increasing_id()).select("row", "id", "n_chunks", "text", F.posexplode(starts).alias("n", "start"))
    several = several.select("row", "id", "n_chunks", "n", "start", F.expr(f"substring(text, int(start) + 1, {chunk_chars})").alias("part"))
    pieces, whole = _stitched(several, source, chunk_chars, overlap_chars)
    single = single.unionByName(whole.select("id", F.lit(0).alias("start"), "part", F.lit(0).alias("cut"), F.lit(None).cast("bigint").alias("next_cut")))
    ids = pieces.mapInArrow(_pieces(source, lambda c, ids: (ids,), ["row", "id", "n"], ["ids"], [("int32",)]), f"row bigint, id {id_type}, n int, ids array<int>")
    ids = ids.groupBy("row").agg(F.first("id").alias("id"), F.flatten(F.expr("transform(array_sort(collect_list(struct(n, ids))), x -> x.ids)")).alias("ids")).select("id", "ids")
    if digest:
        names, types, schema = ["n_tokens", "ids_sha256", "decoded_sha256"], ["int64", "string", "string"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        out = ids.mapInArrow(_mapper(source, "id", "ids", _digest, names, types), f"id {id_type}, {schema}")
        made = single.mapInArrow(_pieces(source, _digest, ["id"], names, types), f"id {id_type}, {schema}")
    else:
        out, made = ids, single.mapInArrow(_pieces(source, lambda c, ids: (ids,), ["id"], ["ids"], [("int32",)]), f"id {id_type}, ids array<int>")
    return made.unionByName(out).withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids into (id_col, bytes binary); a null or empty array gives no bytes. An unknown id is an error."""
    source = CodecSource(df.sparkSession, ranks_path, pattern)
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    run = _mapper(source, "id", "ids", lambda c, ids: (c.decode(ids or []),), ["bytes"], ["binary"])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)
