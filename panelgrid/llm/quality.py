"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its n-grams: hashed byte trigrams, and for adjacent equal words
and lines the power of two of their number. They are scaled by the log ratio of the smoothed class
counts, and a linear model with hinge loss is fitted to the scaled indicators by dual coordinate
descent. Margins become probabilities by a logistic fit on folds that the model hasn't seen.

The fit is on the driver and uses at most TRAIN_ROWS labelled rows, chosen by a hash of their id;
scores cover every row and its whole text, of any length, in one pass over its bytes. Null counts as empty text, which has
no indicators and the score of the intercept. If the labels in the sample are all alike or absent, the score is their
smoothed share. Of rows that repeat a labelled id one counts, that of the smallest set of indicators, and a label that
is repeated counts once; different labels of one id count each. Rows are scored one by one, repeated or not, and equal
texts alike. A null id is never in the sample. An empty table gives no rows, and an empty sample even scores.
Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the sample that the model is fitted on.
TRAIN_ROWS = 4_000
BITS = 16
#: Slots after the hashed ones for repeated words and lines.
REPEATS = 24
SMOOTHING, COST, EPOCHS, FOLDS, SEED = 1.0, 3.0, 12, 4, 7


class Indicators:
    """Finds the distinct features of a text; reuses one buffer."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        data = (text or "").encode()
        extra = [(1 << BITS) + base + min(n.bit_length(), REPEATS // 2 - 1) for base, n in ((0, _repeats(data.split())), (REPEATS // 2, _repeats(data.split(b"\n")))) if n]
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        if len(a) < 3:
            return np.array(extra, np.int32)
        code = ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        self.seen[code] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return np.concatenate([found, np.array(extra, np.int64)]).astype(np.int32)


def _repeats(parts: list[bytes]) -> int:
    return sum(map(bytes.__eq__, parts, parts[1:]))


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, log ratios included
    ratios: np.ndarray  # squared log ratios, for the length of a row
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(self.ratios[found].sum() + 1e-9)) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def _support_vectors(rows: list[np.ndarray], y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (log ratios included), squared log ratios, bias."""
    size = (1 << BITS) + REPEATS
    counts = np.full((2, size), SMOOTHING)
    for found, label in zip(rows, y, strict=True):
        counts[int(label > 0), found] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    scaled = [(v := ratio[found]) / np.sqrt(v @ v + 1e-9) for found in rows]
    # dual coordinate descent for hinge loss; the bias is a feature of value 1
    alpha, w, bias, r = np.zeros(len(y)), np.zeros(size), 0.0, np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in r.permutation(len(y)):
            found, x = rows[i], scaled[i]
            slack = 1 - y[i] * (w[found] @ x + bias)
            new = min(max(alpha[i] + slack / (x @ x + 1.0), 0.0), COST)
            step, alpha[i] = (new - alpha[i]) * y[i], new
            if step:
                w[found] += step * x
                bias += step
    return w * ratio, ratio**2, bias


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y > 0) = 1 / (1 + exp(-(slope m + shift))), by Newton's method with smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, b = np.stack([m, np.ones_like(m)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """labels: 0 or 1."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    size = (1 << BITS) + REPEATS
    if min((y > 0).sum(), (y < 0).sum()) < FOLDS:
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))
    fold, m = np.random.default_rng(SEED).permutation(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS):
        w, r2, bias = _support_vectors([rows[i] for i in np.flatnonzero(fold != k)], y[fold != k], k)
        part = Model(w, r2, bias, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            m[i] = part.margin(rows[i])
    slope, shift = _logistic(m, y)
    w, r2, bias = _support_vectors(rows, y, FOLDS)
    return Model(w, r2, bias, slope, shift)


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the rows of df that labels marks. where: a condition on labels; train_rows: the bound of the sample."""
    chosen = labels if where is None else labels.where(where)
    chosen = chosen.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    # train_rows ids and labels at most: some 64 KB to broadcast
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        indicators, size = Indicators(), (1 << BITS) + REPEATS
        for b in batches:
            bits = np.zeros((b.num_rows, size), bool)
            for k, text in enumerate(b.column("text")):
                bits[k, indicators(text.as_py())] = True
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["id", "label", "found"])

    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, found binary")
    # one row for each of train_rows ids and labels, of some 8 KB, however often an id is repeated
    found = made.groupBy("id", "label").agg(F.min("found").alias("found")).collect()
    found.sort(key=lambda r: (r.id, r.label))
    sample = [np.flatnonzero(np.unpackbits(np.frombuffer(r.found, np.uint8))) for r in found]
    return fit_rows(sample, np.array([r.label for r in found]))


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns per row id_col, score (0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the table
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, indicators = shared.value, Indicators()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([model.score(indicators(t)) for t in b.column("text").to_pylist()], pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep(df: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of df that score at least ``least``, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, indicators = shared.value, Indicators()
        for b in batches:
            yield b.filter(pa.array([model.score(indicators(t)) >= least for t in b.column(text_col).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
