"""Near-duplicate documents by MinHash in an LSH forest.

Words are what white space (ASCII) leaves after lower-casing A-Z; a document's set is that of its
distinct shingles of five words (of fewer words: the whole sequence). Documents of equal sets are one
node. Each of TREES orders sorts the nodes by a rotation of their signature, by ranges over all
tasks, so that the nodes with the longest common prefixes are neighbours. Neighbours that share
LEAST_DEPTH values form a region; a sweep along the order compares each node with the nearest nodes
before it in its region. How deep a prefix the sweep's window has adapts to the region: a small
region is swept whole, from a crowded one only the nodes with longer common prefixes.

1. In a first sweep each node proposes, in each order, the neighbour whose signature agrees with its own
   in the most values. Proposals are confirmed on full sets (64-bit hashes of shingles,
   100 * intersection >= 75 * union), and regions that have become one component leave.
2. What is left, regions of several components, is swept again with the full sets in the rows and a
   wider window; every likely pair of different components in the window is compared on the spot and
   only links leave the task.

Work and rows are thus in proportion to the nodes: no group emits its pairs, no bucket is capped to
drop rows, and a region of any size is dealt over many tasks, with the ends of neighbouring tasks
compared apart. What is left to chance: that a pair shares a region (0.9995 at 0.75, more above), that
its signatures agree in LEAST_AGREED of 80 values (all but 10^-6 at 0.75), and, in regions with more
nodes than CLOSING_WINDOW, that it lies within that window in one of the orders or is joined by other
links; see the README for the recall measured.

Null counts as empty text, without shingles, which links with nothing. Rows that repeat are linked as
copies; rows of a null id are returned with a component of their own group's least id (null if all its
ids are). Texts of any length are read whole. An empty table gives an empty result. Other columns, of
any name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .components import components

SHINGLE_WORDS = 5
#: Link from this share of a union on, in hundredths.
LEAST_PERCENT = 75
#: TREES * LEAST_DEPTH values make a signature: a pair at 0.75 shares a region with probability 1 - (1 - 0.75^4)^20 = 0.9995.
TREES, LEAST_DEPTH, SORTED_DEPTH = 20, 4, 12
#: A pair is likely if so many values of its signatures agree.
LEAST_AGREED = 40
#: Nodes before it in its region that a node is compared with by signatures, in the first and in the closing sweep.
WINDOW, CLOSING_WINDOW = 64, 512
#: Rows of an order in each task, without and with sets.
ROWS_EACH, ROWS_WITH_SETS = 20_000, 5_000
CACHE_WORDS = 200_000

_PAIR = "a bigint, b bigint, agreed int"
_ROW = "key bigint, node bigint, component bigint, n bigint, sketch binary"


class Shingler:
    """Hashes the distinct shingles of a text; remembers the hashes of words."""

    def __init__(self) -> None:
        import xxhash

        self._hash, self._words = xxhash.xxh3_64_intdigest, {}
        r = np.random.default_rng(20150101)
        self.odd = r.integers(1, 2**63, (SHINGLE_WORDS + 1, SHINGLE_WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = np.uint64(0x9E3779B97F4A7C15)
        self.orders = r.integers(1, 2**63, TREES * LEAST_DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes, uint64."""
        words = (text or "").encode().lower().split()
        known = self._words
        try:
            h = [known[w] for w in words]
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._hash(w)
            h = [known[w] for w in words]
        h = np.array(h, np.uint64)
        k = min(len(h), SHINGLE_WORDS)
        if not k:
            return h
        s = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            s += h[i : len(h) - k + 1 + i] * self.odd[k, i]
        s = (s ^ (s >> np.uint64(29))) * self.mix
        return np.unique(s ^ (s >> np.uint64(32)))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """For each order the least of the shingles' values, as uint32."""
        least = np.full(len(self.orders), 2**32 - 1, np.uint32)
        for i in range(0, len(shingles), 1024):
            part = (shingles[i : i + 1024, None] * self.orders) >> np.uint64(32)
            least = np.minimum(least, part.min(0).astype(np.uint32))
        return least


def _signatures(rows: DataFrame) -> DataFrame:
    """(id, hash, n, digest, sig, sketch) of (id, hash, text): the signature as bytes that sort as its
    values do, the sketch its values' low bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        shingler = Shingler()
        for b in batches:
            sets = [shingler(t) for t in b.column("text").to_pylist()]
            sigs = [shingler.signature(s) for s in sets]
            cols = [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.astype(">u4").tobytes() for s in sigs], [s.astype(np.uint8).tobytes() for s in sigs]]
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), *made], names=["id", "hash", "n", "digest", "sig", "sketch"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash bigint, n bigint, digest binary, sig binary, sketch binary")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, shingles) of (node, text), once for each node."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler()
        for b in batches:
            sets = [shingler(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"])

    # rows that repeat id and text give their node's set more than once
    return rows.mapInArrow(run, "node bigint, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s_{k}"))
    # only the sets that the pairs need are shuffled
    both = pairs.join(side("b"), "b").join(side("a").join(pairs.select("a").distinct(), "a", "left_semi"), "a")
    both = both.select("a", "b", (F.size("s_a") + F.size("s_b")).alias("total"), F.size(F.array_intersect("s_a", "s_b")).alias("common"))
    return both.where(100 * F.col("common") >= LEAST_PERCENT * (F.col("total") - F.col("common"))).select("a", "b")


def _mixed(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, tree, node, component) of the regions that have more than one component."""
    rows = regions.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stats = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    return rows.join(stats.repartition(shuffle_partitions(rows.sparkSession)), "key").select("key", "tree", "node", "component")


def _likely_pairs(key: np.ndarray, component: np.ndarray, n: np.ndarray, sketch: np.ndarray, first: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i from `first` on and j before them, of one region and different components, whose sizes
    (exactly) and signatures allow a link, and the number of values that agree."""
    place = np.arange(len(key))
    starts = np.flatnonzero(np.append([True], key[1:] != key[:-1])[: len(key)])
    place -= np.repeat(starts, np.diff(np.append(starts, len(key))))
    rows, out = np.arange(first, len(key)), []
    for d in range(1, window + 1):
        rows = rows[place[rows] >= d]
        if not len(rows):
            break
        i = rows[component[rows] != component[rows - d]]
        j = i - d
        fit = 100 * np.minimum(n[i], n[j]) >= LEAST_PERCENT * np.maximum(n[i], n[j])
        i, j = i[fit], j[fit]
        agreed = (sketch[i] == sketch[j]).sum(1)
        fit = agreed >= LEAST_AGREED
        out.append((i[fit], j[fit], agreed[fit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def _best_of(i: np.ndarray, j: np.ndarray, agreed: np.ndarray) -> np.ndarray:
    """Which pairs are the best of either row."""
    keep = np.zeros(len(i), bool)
    for side in (i, j):
        order = np.lexsort((-agreed, side))
        keep[order[np.unique(side[order], return_index=True)[1]]] = True
    return keep


class _Sweep:
    """Pairs that a sweep along sorted rows yields: each row's best likely one, or with sets the links."""

    def __init__(self, window: int, with_sets: bool):
        self.window, self.with_sets = window, with_sets

    def pairs(self, rows, first: int):  # noqa: ANN001, ANN201
        """Table (a, b, agreed) of an Arrow table of rows; a pair's later row is at `first` or after it."""
        import pyarrow as pa

        key, node, component, n = (rows.column(c).to_numpy() for c in ("key", "node", "component", "n"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1)
        i, j, agreed = _likely_pairs(key, component, n, sketch, first, self.window)
        keep = self._linked(rows.column("shingles").combine_chunks(), component, i, j, agreed) if self.with_sets else _best_of(i, j, agreed)
        i, j, agreed = i[keep], j[keep], agreed[keep]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "agreed": pa.array(agreed, pa.int32())})

    @staticmethod
    def _linked(lists, component: np.ndarray, i: np.ndarray, j: np.ndarray, agreed: np.ndarray) -> np.ndarray:  # noqa: ANN001
        """Which pairs are links, on full sets; components once linked here are not compared again."""
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        keep = np.zeros(len(i), bool)
        for k in np.argsort(-agreed, kind="stable"):
            x, y = find(component[i[k]]), find(component[j[k]])
            if x != y:
                s, t = (flat[ends[r] : ends[r + 1]] for r in (i[k], j[k]))
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= LEAST_PERCENT * (len(s) + len(t) - common):
                    keep[k], up[max(x, y)] = True, min(x, y)
        return keep

    def run(self, batches: Iterator) -> Iterator:
        """Pairs of the task's own rows, and its first and last rows for the tasks beside it."""
        import pyarrow as pa

        part, held, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            rows = pa.table(b)
            if seen < self.window:
                yield from self._edge(rows.slice(0, self.window - seen), part, 1, seen)
            seen += len(rows)
            whole = rows if held is None else pa.concat_tables([held, rows])
            yield from self._filled(self.pairs(whole, len(whole) - len(rows)))
            held = whole.slice(max(0, len(whole) - self.window))
        if held is not None:
            yield from self._edge(held, part + 1, 0, 0)

    def _edge(self, rows, edge: int, side: int, at: int) -> Iterator:  # noqa: ANN001
        """Rows on one side of an edge between tasks: 0 before it, 1 after it."""
        import pyarrow as pa

        n = len(rows)
        for name, values in (("edge", np.full(n, edge)), ("side", np.full(n, side)), ("at", np.arange(at, at + n))):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return self._filled(rows)

    def _filled(self, rows) -> Iterator:  # noqa: ANN001
        """Batches with all columns of the output; nulls in those that rows doesn't have."""
        import pyarrow as pa

        types = {"a": pa.int64(), "b": pa.int64(), "agreed": pa.int32(), "key": pa.int64(), "node": pa.int64(), "component": pa.int64(), "n": pa.int64(), "sketch": pa.binary()}
        types |= ({"shingles": pa.list_(pa.int64())} if self.with_sets else {}) | {"edge": pa.int64(), "side": pa.int64(), "at": pa.int64()}
        cols = [rows.column(c).cast(t) if c in rows.column_names else pa.nulls(len(rows), t) for c, t in types.items()]
        return iter(pa.table(cols, names=list(types)).to_batches())

    def at_edge(self, rows):  # noqa: ANN001, ANN201
        """Pairs between the last rows of a task and the first ones of the next."""
        rows = rows.sort_by([("side", "ascending"), ("at", "ascending")])
        return self.pairs(rows, int((rows.column("side").to_numpy() == 0).sum()))


def _swept(mixed: DataFrame, nodes: DataFrame, scratch: Scratch, *, window: int, sets: DataFrame | None = None) -> DataFrame:
    """(a, b, agreed) of a sweep along all orders of rows (key, tree, node, component); written, to be dropped by the caller."""
    width = 4 * LEAST_DEPTH
    rows = mixed.join(nodes.select("node", "n", "sig", "sketch"), "node")
    place = F.expr(f"substring(concat(sig, sig), tree * {width} + 1, {4 * SORTED_DEPTH})")
    rows = rows.select("tree", place.alias("place"), "key", "node", "component", "n", "sketch")
    parts = -(-mixed.count() // (ROWS_WITH_SETS if sets is not None else ROWS_EACH)) or 1
    own, schema = ["key", "node", "component", "n", "sketch"], f"{_PAIR}, {_ROW}"
    if sets is not None:
        rows, own, schema = rows.join(sets, "node"), [*own, "shingles"], f"{schema}, shingles array<bigint>"
    sweep = _Sweep(window, sets is not None)
    rows = rows.repartitionByRange(parts, "tree", "place", "node").sortWithinPartitions("tree", "place", "node").select(*own)
    out = scratch.write(rows.mapInArrow(sweep.run, f"{schema}, edge bigint, side bigint, at bigint"))
    beside = out.where("edge is not null").drop("a", "b", "agreed").groupBy("edge").applyInArrow(lambda rows: sweep.at_edge(rows), _PAIR)
    pairs = scratch.write(out.where("edge is null").select("a", "b", "agreed").unionByName(beside).groupBy("a", "b").agg(F.max("agreed").alias("agreed")))
    scratch.drop(out)
    return pairs


def _forest(nodes: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes that have links."""
    spark = nodes.sparkSession
    places = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    places = places.select("tree", "node", F.xxhash64("tree", F.expr(f"substring(sig, tree * {4 * LEAST_DEPTH} + 1, {4 * LEAST_DEPTH})")).alias("key"))
    shared = places.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    regions = scratch.write(places.join(shared.repartition(shuffle_partitions(spark)), "key"))
    wanted = regions.select("node").distinct().join(nodes.select("node", "id", "hash"), "node")
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]) & (rows["hash"] == wanted["hash"])).select("node", "text")
    sets = scratch.write(_sets(texts))
    pairs = _swept(regions.withColumn("component", F.col("node")), nodes, scratch, window=WINDOW)
    links = scratch.write(_confirmed(pairs, sets))
    classes = scratch.write(components(links))
    scratch.drop(pairs)
    mixed = scratch.write(_mixed(regions, classes))
    more = _swept(mixed, nodes, scratch, window=CLOSING_WINDOW, sets=sets)
    scratch.drop(regions, sets, mixed, links)
    # a sweep has compared all that another one would, so its links are the last
    if not more.isEmpty():
        before = classes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes, old = scratch.write(components(before.unionByName(more.select("a", "b")))), classes
        scratch.drop(old)
    scratch.drop(more)
    return classes


def near_dups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id (least id reachable by links), kept."""
    parts, scratch = shuffle_partitions(df.sparkSession), Scratch(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    signed = scratch.write(_signatures(rows))
    nodes = signed.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("least"), F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    # numbered once and written, so that a task that runs again doesn't number them anew
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least_id", F.col("least.id").alias("id"), F.col("least.hash").alias("hash"), "n", "sig", "sketch"))
    named = nodes.select("node", "digest", "least_id").join(_forest(nodes, rows, scratch), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least.repartition(parts), "component").select("digest", "component_id")
    out = signed.where("n > 0").select("id", "n", "digest").join(named.repartition(parts), "digest").select("id", "n", "component_id")
    out = out.unionByName(signed.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one of each component, with all their columns; rows of a null id stay."""
    lost = near_dups(df, id_col=id_col, text_col=text_col).where("not kept").select(F.col(id_col).alias("lost_id")).dropna().distinct()
    # the columns of df in a struct, so that no name of theirs can clash
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("own_id"))
    return rows.join(lost, F.col("own_id") == F.col("lost_id"), "left_anti").select("row.*")
