"""Leakage audits: does anything of the future reach the past, or a model's training its test?"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.tails import student_upper

from .folds import train_and_test
from .ic import rank_ic

Transform = Callable[[DataFrame], DataFrame]


class LeakageError(AssertionError):
    """A transform sees the future, or a model predicts permuted labels."""


def _changed(left: DataFrame, right: DataFrame, out: str, atol: float) -> DataFrame:
    """Cells of both whose values differ; null against a value differs."""
    both = left.select("datetime", "instrument", F.col(out).alias("before")).join(right.select("datetime", "instrument", F.col(out).alias("after")), ["datetime", "instrument"])
    same = F.col("before").eqNullSafe(F.col("after")) | F.coalesce(F.abs(F.col("before") - F.col("after")) <= atol, F.lit(False))
    return both.where(~same)


def causality_probe(grid: DataFrame, col: str, transform: Transform, out: str, *, position: int, extreme: float = 1e6, atol: float = 1e-12) -> DataFrame:
    """Cells at the position that move when all later rows become extreme or missing in turn: none if the transform is causal."""
    pos = F.col("pos")
    shaken = grid.withColumn(col, F.when(pos <= position, F.col(col)).when((pos - position) % 2 == 1, None).otherwise(F.lit(extreme)))
    return _changed(transform(grid).where(pos == position), transform(shaken).where(pos == position), out, atol)


def assert_causal(grid: DataFrame, col: str, transform: Transform, out: str, **kwargs) -> None:
    last = grid.agg(F.max("pos")).first()[0]
    kwargs.setdefault("position", last // 2)
    if kwargs["position"] >= last:
        raise ValueError("the probe has to leave a later row")
    if n := causality_probe(grid, col, transform, out, **kwargs).count():
        raise LeakageError(f"{n} cells at position {kwargs['position']} depend on later rows")


def prefix_invariance(grid: DataFrame, col: str, transform: Transform, out: str, *, keep: int, future: float = 1e9, atol: float = 0.0) -> DataFrame:
    """Cells before position keep that differ between a run on them alone and one with an overwritten future: none if causal."""
    pos = F.col("pos")
    alone = transform(grid.where(pos < keep))
    longer = transform(grid.withColumn(col, F.when(pos < keep, F.col(col)).otherwise(F.lit(future)))).where(pos < keep)
    return _changed(alone, longer, out, atol)


def date_permutation(days: DataFrame, seed: int, replicates: Sequence[int]) -> DataFrame:
    """(b, datetime, source): for each replicate a bijection of dates, by the order of a hash."""
    each = days.select("datetime", "pos").crossJoin(F.broadcast(days.sparkSession.createDataFrame([(b,) for b in replicates], "b int")))
    key = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("b").cast("string"), F.col("datetime").cast("string")))
    placed = each.withColumn("to", (F.row_number().over(Window.partitionBy("b").orderBy(key)) - 1).cast("bigint"))
    return placed.select("b", F.col("datetime").alias("source"), "to").join(F.broadcast(days.select("datetime", F.col("pos").alias("to"))), "to").select("b", "datetime", "source")


#: Rows of a mapping of dates up to which it is broadcast (some 20 MB).
BROADCAST_ROWS = 1_000_000


def permute_labels(labels: DataFrame, mapping: DataFrame, col: str = "label", *, rows: int | None = None) -> DataFrame:
    """Whole cross-sections move from source to datetime, by key. rows: how many the mapping has; where they are
    known and few it is broadcast, else joined."""
    moved = labels.select(F.col("datetime").alias("source"), "instrument", col)
    small = rows is not None and rows <= BROADCAST_ROWS
    return moved.join(F.broadcast(mapping) if small else mapping, "source").select("b", "datetime", "instrument", col)


def expanding_folds(n_dates: int, n_folds: int, radius: int) -> list[tuple[int, int, int, int]]:
    """(fold, train_end, test_from, test_to): positions below train_end train, [test_from, test_to) test. The first block only trains."""
    cut = [int(x) for x in np.linspace(0, n_dates, n_folds + 2)]
    return [(k, cut[k + 1] - radius, cut[k + 1], cut[k + 2]) for k in range(n_folds)]


Folds = Sequence[tuple[int, int, int, int]] | DataFrame | int


def _rows_of_folds(rows: DataFrame, folds: Folds, seed: int) -> DataFrame:
    """Each row once for every fold in which it trains or tests, with whether it trains. Folds are expanding
    ones, or a table (split, datetime, role). A number of folds deals single rows to them by a hash: a negative
    control, as the same date, and copies of a row, then stand on both sides."""
    if isinstance(folds, DataFrame):
        return train_and_test(rows, folds, "split")
    if isinstance(folds, int):
        own = F.pmod(F.xxhash64(F.lit(seed), "datetime", "instrument"), F.lit(folds)).cast("int")
        return rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("train", F.col("fold") != own)
    table = rows.sparkSession.createDataFrame(list(folds), "fold int, train_end bigint, test_from bigint, test_to bigint")
    dealt = rows.join(F.broadcast(table), (F.col("pos") < F.col("train_end")) | ((F.col("pos") >= F.col("test_from")) & (F.col("pos") < F.col("test_to"))))
    return dealt.withColumn("train", F.col("pos") < F.col("train_end")).drop("train_end", "test_from", "test_to")


def ridge_oos(rows: DataFrame, features: Sequence[str], folds: Folds, *, alpha: float = 1.0, by: Sequence[str] = (), label: str = "label", min_train: int = 10, seed: int = 0) -> DataFrame:
    """Out-of-sample predictions of a ridge with a free intercept, per fold (and by). rows: datetime,
    instrument, pos, features, label. Only the sums of products of each fold reach the driver."""
    usable = F.col(label).isNotNull()
    for f in features:
        usable = usable & F.col(f).isNotNull()
    dealt = _rows_of_folds(rows.where(usable), folds, seed)
    xs = ["1D", *[f"`{f}`" for f in features]]
    products = [F.sum(F.expr(f"CAST({a} AS DOUBLE) * {b}")).alias(f"p{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate([*xs, f"`{label}`"]) if j >= i]
    keys = [*by, "fold"]
    sums = dealt.where("train").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *products).collect()
    k, solved = len(xs), []
    for r in sums:
        if r.n < min_train:
            continue
        gram = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        right = np.array([r[f"p{i}_{k}"] for i in range(k)])
        penalty = alpha * np.eye(k)
        penalty[0, 0] = 0
        solved.append((*[r[c] for c in keys], [float(v) for v in np.linalg.lstsq(gram + penalty, right, rcond=None)[0]]))
    types = {c: dealt.schema[c].dataType.simpleString() for c in keys}
    weights = rows.sparkSession.createDataFrame(solved, ", ".join(f"{c} {types[c]}" for c in keys) + ", beta array<double>")
    test = dealt.where("not train").join(F.broadcast(weights), keys)
    score = F.element_at("beta", 1)
    for i, f in enumerate(features):
        score = score + F.element_at("beta", i + 2) * F.col(f)
    return test.select(*by, "fold", "datetime", "instrument", score.alias("score"), F.col(label).alias("label"))


def model_oos(rows: DataFrame, features: Sequence[str], folds: Folds, model: Callable, *, by: Sequence[str] = (), label: str = "label", min_train: int = 10, seed: int = 0) -> DataFrame:
    """The same for a user's model(train_x, train_y, test_x) -> predictions; a fold's rows meet in one task."""
    dealt = _rows_of_folds(rows.dropna(subset=[*features, label]), folds, seed)
    keys = [*by, "fold"]
    kinds = {c: dealt.schema[c].dataType.simpleString() for c in [*keys, "datetime", "instrument"]}

    def run(part):
        train, test = part[part.train], part[~part.train]
        out = test[[*keys, "datetime", "instrument"]].copy()
        if len(train) < min_train or not len(test):
            return out.iloc[:0].assign(score=[], label=[])
        out["score"] = np.asarray(model(train[list(features)].to_numpy(float), train[label].to_numpy(float), test[list(features)].to_numpy(float)), float)
        out["label"] = test[label].to_numpy(float)
        return out

    return dealt.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", score double, label double")


#: Dates of a block. A task holds the cross-sections of two blocks.
DATES = 8


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[place]


def _tiles_of_dates(rows: DataFrame, features: Sequence[str], label: str, n_days: int) -> DataFrame:
    """(i, j, cells): for each two blocks of dates the features of the one's dates and the labels of the other's, each date as (side, pos, k, v) with the numbers of
    its instruments and their values, feature by feature."""
    names = rows.select("instrument").distinct().withColumn("k", (F.row_number().over(Window.orderBy("instrument")) - 1).cast("int"))
    blocks = F.sequence(F.lit(0), F.lit((n_days - 1) // DATES))
    numbered = rows.join(names, "instrument")

    def side(number: int, columns: Sequence[str], own: str, other: str) -> DataFrame:
        full = numbered.dropna(subset=list(columns)).select("pos", F.struct("k", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).alias("c"))
        dates = full.groupBy("pos").agg(F.collect_list("c").alias("c"))
        cells = F.struct(F.lit(number).alias("side"), F.col("pos").cast("int").alias("pos"), F.col("c.k").alias("k"), F.flatten(F.array(*[F.col(f"c.v{i}") for i in range(len(columns))])).alias("v"))
        return dates.select(F.floor(F.col("pos") / DATES).cast("int").alias(own), F.explode(blocks).alias(other), cells.alias("cells")).select("i", "j", "cells")

    both = side(0, features, "i", "j").unionByName(side(1, [label], "j", "i"))
    return both.repartition(((n_days - 1) // DATES + 1) ** 2, "i", "j").groupBy("i", "j").agg(F.collect_list("cells").alias("cells"))


def _of_tiles(tiles: DataFrame, wanted: dict, made: Callable, schema: str) -> DataFrame:
    """Rows that made(x, y, t, s, what) yields for each date t of features and s of labels of which something is wanted: x (one row per feature) and y are
    the values of the instruments that have both."""
    shared = tiles.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
        for b in batches:
            for cells in b["cells"]:
                own, found = ({}, {}), []
                parts = cells.values
                k, v = parts.field("k"), parts.field("v")
                for r, (which, pos) in enumerate(zip(parts.field("side").to_pylist(), parts.field("pos").to_pylist(), strict=True)):
                    numbers = k[r].values.to_numpy(zero_copy_only=False)
                    order = np.argsort(numbers)
                    own[which][pos] = (numbers[order], v[r].values.to_numpy(zero_copy_only=False).reshape(-1, len(numbers))[:, order])
                for t, s in [(t, s) for t in own[0] for s in own[1] if (t, s) in shared.value]:
                    (kx, x), (ky, y) = own[0][t], own[1][s]
                    _, at_x, at_y = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
                    found += made(x[:, at_x], y[0, at_y], t, s, shared.value[t, s])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, k in zip(zip(*found, strict=True), types, strict=True)], names=list(names))

    return tiles.mapInArrow(run, schema)


def _mean_ics(rows: DataFrame, features: Sequence[str], mapping: DataFrame, days: DataFrame, folds: Sequence[tuple[int, int, int, int]], *, alpha: float, min_obs: int, min_train: int = 10) -> dict:
    """b -> mean rank IC of the ridge's predictions on labels moved by mapping. Every replicate takes labels of whole dates, so its sums of products and
    its cross-sections are those of pairs of dates: these are made by tiles of dates, and no replicate's rows are formed."""
    n_days = days.count()
    at = lambda c: days.select(F.col("datetime").alias(c), F.col("pos").cast("int").alias(f"at_{c}"))
    moves = [tuple(r) for r in mapping.join(F.broadcast(at("datetime")), "datetime").join(F.broadcast(at("source")), "source").select("b", "at_datetime", "at_source").collect()]  # dates of all replicates
    tiles = _tiles_of_dates(rows.drop("pos").join(F.broadcast(days), "datetime"), features, "label", n_days)

    def products(x, y, t, s, _):
        design = np.vstack([np.ones(len(y)), x])
        return [(t, s, len(y), (design @ np.vstack([design, y]).T).ravel().tolist())]

    size = len(features) + 1
    trains = max(f[1] for f in folds)
    sums = {(r.t, r.s): (r.n, np.array(r.p).reshape(size, size + 1)) for r in _of_tiles(tiles, {(t, s): None for _, t, s in moves if t < trains}, products, "t int, s int, n bigint, p array<double>").collect()}
    penalty = alpha * np.eye(size)
    penalty[0, 0] = 0
    wanted: dict = {}
    for b in sorted({m[0] for m in moves}):
        own = sorted((t, s) for c, t, s in moves if c == b)
        for _, end, low, high in folds:
            used = [sums[m] for m in own if m[0] < end and m in sums]
            if sum(n for n, _ in used) < min_train:
                continue
            total = sum(p for _, p in used)
            beta = np.linalg.lstsq(total[:, :size] + penalty, total[:, size], rcond=None)[0]
            for t, s in own:
                if low <= t < high:
                    wanted.setdefault((t, s), []).append((b, beta))

    def ics(x, y, t, s, asked):
        if len(y) < min_obs:
            return []
        out, ry = [], _average_ranks(y)
        ry = ry - ry.mean()
        for b, beta in asked:
            rx = _average_ranks(beta[0] + beta[1:] @ x)
            rx = rx - rx.mean()
            spread = float(np.sqrt((rx @ rx) * (ry @ ry)))
            out += [(b, float(rx @ ry) / spread)] if spread else []
        return out

    found = _of_tiles(tiles, wanted, ics, "b int, ic double").groupBy("b").agg(F.avg("ic").alias("ic"))
    return {r.b: r.ic for r in found.collect()}


def _mean_ics_of_rows(rows: DataFrame, features: Sequence[str], mapping: DataFrame, folds: Folds, model: Callable | None, *, rows_of_mapping: int, alpha: float, min_obs: int, seed: int) -> dict:
    """The same for a user's model and for folds of single rows, which need every replicate's rows."""
    moved = permute_labels(rows.select("datetime", "instrument", "label"), mapping, rows=rows_of_mapping)
    all_rows = rows.select("datetime", "instrument", "pos", *features).join(moved, ["datetime", "instrument"])
    scored = model_oos(all_rows, features, folds, model, by=["b"], seed=seed) if model else ridge_oos(all_rows, features, folds, alpha=alpha, by=["b"], seed=seed)
    # each (replicate, date) is a cross-section of its own
    one = scored.select("b", F.struct("b", "datetime").alias("datetime"), "instrument", "score", "label")
    ics = rank_ic(one, min_obs=min_obs).select(F.col("datetime.b").alias("b"), "ic").groupBy("b").agg(F.avg("ic").alias("ic"))
    return {r.b: r.ic for r in ics.collect()}


def leakage_audit(rows: DataFrame, features: Sequence[str], days: DataFrame, *, radius: int, n_permutations: int = 200, n_folds: int = 3, alpha: float = 0.01, ridge: float = 1.0, seed: int = 20240101, min_obs: int = 10, model: Callable | None = None, fold_scheme: str = "purged") -> dict:
    """Mean out-of-sample rank IC on labels whose dates are permuted, all replicates in one job, and a
    one-sided t test of its mean; the unpermuted IC is reported with it. fold_scheme "overlapping" is the
    negative control in which rows of one date stand on both sides."""
    if fold_scheme not in ("purged", "overlapping"):
        raise ValueError(f"unknown fold scheme {fold_scheme!r}")
    n_days = days.count()
    folds = n_folds if fold_scheme == "overlapping" else expanding_folds(n_days, n_folds, radius)
    mapping = date_permutation(days, seed, range(1, n_permutations + 1)).unionByName(days.select(F.lit(0).alias("b"), "datetime", F.col("datetime").alias("source")))
    if model or fold_scheme == "overlapping":
        by_b = _mean_ics_of_rows(rows, features, mapping, folds, model, rows_of_mapping=n_days * (n_permutations + 1), alpha=ridge, min_obs=max(3, min_obs), seed=seed)
    else:
        by_b = _mean_ics(rows, features, mapping, days, folds, alpha=ridge, min_obs=max(3, min_obs))
    shuffled = np.array([v for b, v in by_b.items() if b and v is not None], float)
    if len(shuffled) < 2:
        raise RuntimeError("fewer than two replicates have a statistic, so there is no verdict")
    mean, sd = float(shuffled.mean()), float(shuffled.std(ddof=1))
    t = mean / (sd / math.sqrt(len(shuffled))) if sd else (math.inf if mean > 0 else 0.0)
    p = student_upper(t, len(shuffled) - 1) if sd else float(mean <= 0)
    return {"observed_ic": by_b.get(0), "shuffle_mean_ic": mean, "shuffle_std_ic": sd, "t_statistic": t, "p_value": p, "q05": float(np.quantile(shuffled, 0.05)), "q95": float(np.quantile(shuffled, 0.95)), "n_permutations": len(shuffled), "verdict": "leakage_detected" if p < alpha else "clean"}


def assert_no_leakage(*args, **kwargs) -> dict:
    result = leakage_audit(*args, **kwargs)
    if result["verdict"] != "clean":
        raise LeakageError(f"labels of permuted dates are predicted: {result}")
    return result
