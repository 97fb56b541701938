"""Near-duplicate embeddings by an epsilon grid order join.

Equal vectors are one node with a multiplicity. The nodes' unit vectors are rotated to their
principal axes (of all nodes), sorted by the grid cells of side epsilon along the leading axes, and
cut into intervals of the sequence. Pairs of intervals are joined recursively: pairs whose bounding
boxes are further apart than epsilon are skipped, others split into the intervals below, down to
tiles, within which the recursion goes on over blocks. Cosine t is the distance epsilon =
sqrt(2 - 2 t) between unit vectors, so no link can be skipped.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
rows of a null id. Shorter vectors count as filled up with zeros. Repeated rows are nodes' copies: each
links with the others. An empty table gives an empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, shuffle_partitions
from .components import components

TILE_ROWS, BLOCK_ROWS = 4096, 256
#: Leading axes that the cells and the boxes use.
AXES = 8
#: The recursion starts from at most so many intervals, and splits each by FANOUT.
TOP_INTERVALS, FANOUT = 512, 8


def _sums(nodes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and second moments of all unit vectors: dim * (dim + 1) numbers, combined by Spark."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((dim + 1, dim))
        for b in batches:
            u = _units(b.column("vec"), dim)
            total[:dim] += u.T @ u
            total[dim] += u.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel(), pa.float64())], names=["cell", "value"])

    rows = nodes.select("vec").mapInArrow(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((dim + 1, dim))
    for r in rows:
        total.flat[r.cell] = r.value
    return total[dim], total[:dim]


def _matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(kind)
    out = np.zeros((len(sizes), dim), kind)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    v = v / abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _units(column, dim: int) -> np.ndarray:
    return _scaled(_matrix(column, dim)) if len(column) else np.zeros((0, dim))


def _tiles(nodes: DataFrame, dim: int, axes: np.ndarray, eps: float, kind: str, tile_rows: int) -> DataFrame:
    """Intervals of the epsilon grid order: tile, payload (node, copies, vectors), lo, hi."""
    g = axes.shape[1]

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            y = _units(b.column("vec"), dim) @ axes
            cells = np.floor(y / eps).astype(np.int32)
            values = _matrix(b.column("vec"), dim, kind)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), pa.array([x.tobytes() for x in values], pa.binary()), *(pa.array(cells[:, k]) for k in range(g)), pa.array(y[:, 0])], names=["node", "copies", "vec", *(f"c{k}" for k in range(g)), "y"])

    cells = [f"c{k}" for k in range(g)]
    placed = nodes.select("node", "copies", "vec").mapInArrow(place, "node bigint, copies bigint, vec binary, " + ", ".join(f"{c} int" for c in cells) + ", y double")
    parts = max(1, math.ceil(nodes.count() / tile_rows))
    order = [*cells, "y", "node"]
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, n, count = [], 0, 0

        def made(rows):
            nonlocal count
            node, copies, vec, part = (pa.concat_arrays([b.column(c) for b in rows]) for c in ("node", "copies", "vec", "part"))
            values = np.frombuffer(b"".join(vec.to_pylist()), kind).reshape(len(vec), dim)
            y = _scaled(values.astype(np.float64)) @ axes
            tile = (part[0].as_py() << 32) + count
            count += 1
            bins = [[node.to_numpy().tobytes()], [copies.to_numpy().tobytes()], [values.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array([tile]), *(pa.array(x, pa.binary()) for x in bins), pa.array([y.min(0).tolist()]), pa.array([y.max(0).tolist()])], names=["tile", "node", "copies", "vec", "lo", "hi"])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, tile_rows - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == tile_rows:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return placed.select("node", "copies", "vec", "part").mapInArrow(cut, "tile bigint, node binary, copies binary, vec binary, lo array<double>, hi array<double>")


def _gap2(lo_a, hi_a, lo_b, hi_b):
    """Squared distance of boxes."""
    gap = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return (gap * gap).sum(-1)


def _gap2_sql() -> F.Column:
    one = lambda k: F.greatest(F.lit(0.0), F.element_at("lo_b", k + 1) - F.element_at("hi_a", k + 1), F.element_at("lo_a", k + 1) - F.element_at("hi_b", k + 1))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.size("lo_a") - 1), one), F.lit(0.0), lambda s, x: s + x * x)


def _close_pairs(tiles: DataFrame, eps: float, top: int, fanout: int) -> DataFrame:
    """Pairs (a <= b) of tiles whose boxes are at most eps apart, found level by level."""
    spark = tiles.sparkSession
    most = (eps + 1e-9) ** 2
    # positions in the sequence: tiles of a partition are consecutive
    per_part = tiles.groupBy(F.shiftright("tile", 32).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = per_part.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    boxes = tiles.select("tile", "lo", "hi").join(before, F.shiftright("tile", 32) == F.col("part")).select((F.col("before") + F.col("tile").bitwiseAND(F.lit(2**32 - 1))).alias("at"), "tile", "lo", "hi")
    levels = [checkpointed(boxes)]
    count = levels[0].count()
    axes = range(len(levels[0].select("lo").first()[0])) if count else []
    while count > top:
        up = levels[-1].groupBy(F.floor(F.col("at") / fanout).cast("bigint").alias("at")).agg(F.array(*[F.min(F.element_at("lo", k + 1)) for k in axes]).alias("lo"), F.array(*[F.max(F.element_at("hi", k + 1)) for k in axes]).alias("hi"))
        levels.append(checkpointed(up))
        count = -(-count // fanout)
    head = levels[-1].select("at", "lo", "hi").collect()  # at most ``top`` boxes
    lo, hi = (np.array([r[c] for r in head]).reshape(len(head), -1 if head else 0) for c in ("lo", "hi"))
    pairs = [(x.at, y.at) if x.at <= y.at else (y.at, x.at) for i, x in enumerate(head) for y, d in zip(head[i:], _gap2(lo[i], hi[i], lo[i:], hi[i:]), strict=True) if d <= most]
    pairs = spark.createDataFrame(pairs, "a bigint, b bigint")
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("at") / fanout).cast("bigint"))
        left, right = (child.select(F.col("up").alias(k), F.col("at").alias(f"at_{k}"), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}")) for k in "ab")
        pairs = pairs.join(left, "a").join(right, "b").where("at_a <= at_b").where(_gap2_sql() <= most).select(F.col("at_a").alias("a"), F.col("at_b").alias("b"))
    names = levels[0].select("at", "tile")
    return pairs.join(names.select(F.col("at").alias("a"), F.col("tile").alias("tile_a")), "a").join(names.select(F.col("at").alias("b"), F.col("tile").alias("tile_b")), "b").select("tile_a", "tile_b")


def _linked(a: tuple, b: tuple, same: bool, t: float, eps: float, axes: np.ndarray, block_rows: int):
    """Links between two tiles: (node, links) of every node with a link, and a forest of (node, node)."""
    units = [_scaled(x[2].astype(np.float64)) for x in ((a,) if same else (a, b))]
    units = [units[0], units[-1]]
    small = [u.astype(np.float32) for u in units]
    margin = (units[0].shape[1] + 4) * float(np.finfo(np.float32).eps)
    cut = [range(0, len(u), block_rows) for u in units]
    boxes = []
    for u, c in zip(units, cut, strict=True):
        y = u @ axes
        boxes.append((np.array([y[i : i + block_rows].min(0) for i in c]), np.array([y[i : i + block_rows].max(0) for i in c])))
    links = [np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)]
    forest = set()
    for p, i in enumerate(cut[0]):
        near = np.flatnonzero(_gap2(boxes[0][0][p], boxes[0][1][p], *boxes[1]) <= (eps + 1e-9) ** 2)
        for q in near:
            if same and q < p:
                continue
            j = cut[1][q]
            rows, cols = slice(i, i + block_rows), slice(j, j + block_rows)
            # single precision proposes with the margin of its rounding over all dimensions, double precision decides
            if (small[0][rows] @ small[1][cols].T).max() < t - margin:
                continue
            hit = units[0][rows] @ units[1][cols].T >= t
            if same and p == q:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links[0][rows] += hit @ b[1][cols]
            if not (same and p == q):
                links[0 if same else 1][cols] += hit.T @ a[1][rows]
            x, y = a[0][rows].copy(), b[0][cols].copy()
            while True:  # the least node of each component within the blocks
                ny = np.minimum(y, np.where(hit, x[:, None], np.iinfo(np.int64).max).min(0))
                nx = np.minimum(x, np.where(hit, ny[None, :], np.iinfo(np.int64).max).min(1))
                if (nx == x).all() and (ny == y).all():
                    break
                x, y = nx, ny
            for own, least in ((a[0][rows], x), (b[0][cols], y)):
                forest.update(zip(own[own != least].tolist(), least[own != least].tolist(), strict=True))
    out = [(int(n), int(k)) for own, found in (((a, links[0]),) if same else ((a, links[0]), (b, links[1]))) for n, k in zip(own[0][found > 0], found[found > 0], strict=True)]
    return out, forest


def embedding_links(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS, top: int = TOP_INTERVALS, fanout: int = FANOUT) -> DataFrame:
    """One row per row of df: id_col, n_links (rows linked with it), component_id (least id it reaches), kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold has to be in (0, 1]")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    nodes = good.groupBy("vec").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    dim = nodes.agg(F.max(F.size("vec"))).first()[0] or 1
    kind = "f4" if rows.schema["vec"].dataType.elementType.simpleString() == "float" else "f8"
    total, second = _sums(nodes, dim)
    n = max(1, nodes.count())
    _, axes = np.linalg.eigh(second / n - np.outer(total, total) / n**2)
    axes = axes[:, ::-1][:, : min(AXES, dim)]
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-12
    tiles = checkpointed(_tiles(nodes, dim, axes, max(eps, 1e-6), kind, tile_rows))
    pairs = _close_pairs(tiles, eps, top, fanout)
    payload = lambda k: tiles.select(*[F.col(c).alias(f"{c}_{k}") for c in ("tile", "node", "copies", "vec")])
    work = pairs.join(payload("a"), "tile_a").join(payload("b"), "tile_b")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):  # one pair of tiles at a time
                r = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                a, b = (tuple(np.frombuffer(r[f"{c}_{k}"], t) for c, t in (("node", "i8"), ("copies", "i8"), ("vec", kind))) for k in "ab")
                a, b = ((x[0], x[1], x[2].reshape(-1, dim)) for x in (a, b))
                links, forest = _linked(a, b, r["tile_a"] == r["tile_b"], threshold, eps, axes, block_rows)
                found = [(n, k, None) for n, k in links] + [(x, 0, y) for x, y in forest]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["node", "links", "other"])

    found = checkpointed(work.mapInArrow(run, "node bigint, links bigint, other bigint"))
    classes = components(found.where("other is not null").select("node", "other"))
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    full = nodes.select("node", "vec", "least_id", "copies").join(links, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = full.groupBy("component").agg(F.min("least_id").alias("component_id"))
    full = full.join(least, "component").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(full.repartition(shuffle_partitions(df.sparkSession)), "vec").select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
