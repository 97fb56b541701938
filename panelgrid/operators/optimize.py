"""Mean-variance weights with costs, by Newton steps on multipliers or proximal gradient steps on the covariance.

One rebalance solves

    min  g/2 w'Cw - m'w + buy sum (w - p)+ + sell sum (w - p)- + r/2 |w - ref|^2
    s.t. sum w = budget, lower <= w <= upper, |w - p|_1 <= turnover, |w|_1 <= gross, B'w = 0

A shrunk C is a diagonal and a product of the panel with itself over its dates. Given one multiplier a date and one for each of the
budget and the caps, every instrument's weight follows from its own row, and the multipliers are found by Newton steps: a job each, in
which tasks add up matrices of the calendar's square. Their number doesn't grow with the instruments, and the driver holds no row of an instrument
but the weights it returns.

With a table of pairs, with exposures, or where a name has no curvature of its own, steps are proximal: each is one product with C, a job
(or two) whose tasks add up their own rows. What is one number per instrument (the square root of the table of pairs) is then on the driver:
weights, and the projection, which finds the multipliers of the budget, the turnover and the gross exposure by bisection. Steps are accelerated and
restarted, their length is found by backtracking, and neutrality is enforced by multipliers around them. Either way
multipliers bound how far an objective can be from the best: that gap is returned and decides when to stop.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .risk import Factors, Pairs, Shrunk

#: What a name is given, in this order, in the packed rows of a task.
GIVEN = ("mu", "previous", "lower", "upper", "reference", "own")
#: Values of the panel in a partition, on average, and the least number of names.
PART_CELLS, PART_NAMES = 4_000_000, 500


@dataclass(frozen=True)
class Program:
    """Coefficients and caps. Infinite caps don't bind. Rates are shares of what is traded."""

    risk_aversion: float = 1.0
    shrinkage: float = 0.0
    buy: float = 0.0015
    sell: float = 0.0025
    budget: float = 1.0
    turnover: float = math.inf
    gross: float = math.inf
    neutrality_penalty: float = 1.0
    tolerance: float = 1e-7
    most_steps: int = 2_000

    def __post_init__(self) -> None:
        if self.risk_aversion <= 0 or self.shrinkage < 0 or min(self.buy, self.sell, self.turnover, self.gross, self.neutrality_penalty) < 0:
            raise ValueError("risk aversion has to be positive, and no rate or cap negative")


@dataclass
class Solution:
    """status: optimal, relaxed (by the fallbacks listed) or held. gap bounds the distance of the objective from the best."""

    weights: DataFrame
    status: str
    objective: float
    gap: float
    steps: int
    fallbacks: list[str] = field(default_factory=list)


@dataclass
class _Step:
    """The separable part of a program at given multipliers: of turnover, gross exposure and budget."""

    names: dict[str, np.ndarray]
    program: Program
    turnover: float

    def cost(self, w: np.ndarray) -> float:
        d = w - self.names["previous"]
        return float(self.program.buy * np.maximum(d, 0).sum() + self.program.sell * np.maximum(-d, 0).sum())

    def _pieces(self, of_turnover: float, of_gross: float):
        """Ends of the three stretches between which the slope of costs and multipliers changes, and the slopes."""
        p = self.names["previous"]
        buy, sell = self.program.buy + of_turnover, self.program.sell + of_turnover
        low, high = np.minimum(p, 0), np.maximum(p, 0)
        between = np.where(p > 0, of_gross - sell, buy - of_gross)
        return low, high, (np.full_like(p, -sell - of_gross), between, np.full_like(p, buy + of_gross))

    def nearest(self, y: np.ndarray, length: float, of_turnover: float, of_gross: float, of_budget: float) -> np.ndarray:
        """The least of length/2 (w - y)^2, costs and multipliers, within the bounds."""
        low, high, slopes = self._pieces(of_turnover, of_gross)
        edges = (np.full_like(low, -np.inf), low, high, np.full_like(low, np.inf))
        w = None
        # the function is convex: a stretch's own best point is kept until a later stretch's lies inside it
        for k, slope in enumerate(slopes):
            own = np.clip(y - (slope + of_budget) / length, edges[k], edges[k + 1])
            w = own if w is None else np.where(w < edges[k], w, own)
        return np.clip(w, self.names["lower"], self.names["upper"])

    def projected(self, y: np.ndarray, length: float) -> tuple[np.ndarray, tuple[float, float, float]]:
        p, reach = self.names["previous"], length * (np.abs(y).max() + np.abs(self.names["upper"]).max() + np.abs(self.names["lower"]).max() + 1) + self.program.buy + self.program.sell

        def budgeted(of_turnover: float, of_gross: float):
            low, high = -(reach + of_turnover + of_gross), reach + of_turnover + of_gross
            for _ in range(200):
                middle = (low + high) / 2
                if middle in (low, high):
                    break
                low, high = (middle, high) if self.nearest(y, length, of_turnover, of_gross, middle).sum() > self.program.budget else (low, middle)
            w, v = (self.nearest(y, length, of_turnover, of_gross, x) for x in (low, high))
            # the last step between two neighbouring multipliers: the budget lies between their sums
            share = (w.sum() - self.program.budget) / (w.sum() - v.sum()) if w.sum() != v.sum() else 0.0
            return w + min(max(share, 0.0), 1.0) * (v - w), high

        def capped(of_gross: float):
            w, of_budget = budgeted(0.0, of_gross)
            if np.abs(w - p).sum() <= self.turnover * (1 + 1e-12) + 1e-15:
                return w, (0.0, of_gross, of_budget)
            return _bisected(lambda x: budgeted(x, of_gross), lambda w: np.abs(w - p).sum() - self.turnover, lambda x, b: (x, of_gross, b), reach)

        w, multipliers = capped(0.0)
        if np.abs(w).sum() <= self.program.gross * (1 + 1e-12) + 1e-15:
            return w, multipliers
        return _bisected(capped, lambda w: np.abs(w).sum() - self.program.gross, lambda x, m: (m[0], x, m[2]), reach)

    def least_linear(self, g: np.ndarray, multipliers: tuple[float, float, float]) -> float:
        """The least of g'v with costs over all that is allowed is no less than this."""
        of_turnover, of_gross, of_budget = multipliers
        p, value = self.names["previous"], np.inf
        for v in (self.names["lower"], self.names["upper"], np.clip(p, self.names["lower"], self.names["upper"]), np.clip(0.0, self.names["lower"], self.names["upper"])):
            d = v - p
            own = (g + of_budget) * v + (self.program.buy + of_turnover) * np.maximum(d, 0) + (self.program.sell + of_turnover) * np.maximum(-d, 0) + of_gross * np.abs(v)
            value = np.minimum(value, own)
        caps = (of_turnover * self.turnover if of_turnover else 0.0) + (of_gross * self.program.gross if of_gross else 0.0)
        return float(value.sum() - of_budget * self.program.budget - caps)


def _bisected(at, excess, multipliers, reach: float):
    """The multiplier at which a cap is just kept."""
    low, high = 0.0, reach
    while excess(at(high)[0]) > 0 and high < 1e12 * reach:
        low, high = high, 4 * high
    for _ in range(100):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if excess(at(middle)[0]) > 0 else (low, middle)
    (v, _), (w, rest) = at(low), at(high)
    over, under = excess(v), excess(w)
    share = over / (over - under) if over > 0 and over != under else 1.0
    return v + min(max(share, 0.0), 1.0) * (w - v), multipliers(high, rest)


def bounds_of(names: dict[str, np.ndarray]) -> np.ndarray:
    """What least_turnover needs, as sums: names whose bounds cross, both bounds, and what the bounds make of the previous weights."""
    inside = np.clip(names["previous"], names["lower"], names["upper"])
    return np.array([(names["lower"] > names["upper"]).sum(), names["lower"].sum(), names["upper"].sum(), inside.sum(), np.abs(inside - names["previous"]).sum()])


def least_turnover(bounds: np.ndarray, budget: float) -> float:
    """What has to be traded to come within the bounds and to the budget; infinite if that can't be."""
    crossed, lower, upper, inside, moved = map(float, bounds)
    return math.inf if crossed or not lower - 1e-12 <= budget <= upper + 1e-12 else moved + abs(budget - inside)


def _allowed(bounds: np.ndarray, program: Program) -> tuple[float, list[str]]:
    """The turnover cap, raised by half of itself if that has to be, with that fallback; NaN where nothing is allowed even so."""
    needed, turnover, fallbacks = least_turnover(bounds, program.budget), program.turnover, []
    if needed > turnover + 1e-12:
        turnover *= 1.5
        fallbacks.append("turnover")
    return (math.nan if math.isinf(needed) or needed > turnover + 1e-12 else turnover), fallbacks


@dataclass
class _Sums:
    """At some multipliers: the dual's value, w's own objective and its squared reference, sums of a name's features times its weight, and those features' products
    among names that are free to move. Features: its values by date, one, the sign of its trade and of its weight."""

    dual: float
    base: float
    held: np.ndarray
    curve: np.ndarray


class _Dual:
    """A program over a shrunk matrix by its multipliers: T of the dates (that times the panel make up the risk's slope), of the budget, the turnover and
    the gross exposure. Its dual is smooth and concave where each name has curvature of its own, and made of quadratic pieces, so that Newton
    steps end after finitely many."""

    def __init__(self, names: DataFrame, cov: Shrunk, program: Program) -> None:
        share, n_days = program.risk_aversion * (1 - cov.delta) / max(cov.n_days, 1), cov.n_days
        self.program, self.share, self.n_days = program, share, n_days if share > 0 else 0
        width, own = self.n_days, program.risk_aversion * cov.delta * cov.level
        kind = names.schema["instrument"].dataType.simpleString()

        def packed(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                there = b["cells"].is_valid().to_numpy(zero_copy_only=False)
                x = np.zeros((b.num_rows, width))
                if width and there.any():
                    x[there] = blocks.dense(b["cells"].filter(b["cells"].is_valid()), n_days, 0.0)
                given = np.array([b[c].to_numpy(zero_copy_only=False) for c in GIVEN[:-1]] + [own * there + program.shrinkage], float)
                labels = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b["instrument"])
                yield pa.RecordBatch.from_arrays([labels, pa.array([x.tobytes()], pa.binary()), pa.array([given.tobytes()], pa.binary())], names=["instrument", "x", "given"])

        rows = names.join(cov.rows, "instrument", "left").select("instrument", "cells", *GIVEN[:-1])
        self.kept = rows.mapInArrow(packed, f"instrument array<{kind}>, x binary, given binary").persist()
        self.kind, self.n = kind, self.kept.agg(F.sum(F.size("instrument"))).first()[0] or 0
        most = names.sparkSession.sparkContext.defaultParallelism
        # what is kept is read by fewer tasks, as many as are worth their start
        self.rows = self.kept.coalesce(max(1, min(most, self.n // PART_NAMES), -(-self.n * max(n_days, 1) // PART_CELLS)))

    def _added(self, made, size: int) -> np.ndarray:
        """made(names, x) of each packed row, added up."""
        width = self.n_days

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(size)
            for b in batches:
                for x, given in zip(b["x"].to_pylist(), b["given"].to_pylist(), strict=True):
                    table = np.frombuffer(given).reshape(len(GIVEN), -1)
                    total += made(dict(zip(GIVEN, table, strict=True)), np.frombuffer(x).reshape(table.shape[1], width))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        found = self.rows.select("x", "given").mapInArrow(run, "total binary").collect()  # one row a task
        return sum((np.frombuffer(r.total) for r in found), np.zeros(size))

    def bounds(self) -> np.ndarray:
        return self._added(lambda names, x: bounds_of(names), 5)

    def curved(self) -> bool:
        """Whether each name that may move has curvature of its own."""

        def range_of(names: dict, x: np.ndarray) -> np.ndarray:
            h = names["own"][names["upper"] > names["lower"]]
            return np.array([(h <= 0).sum(), 0.0])

        return not self._added(range_of, 2)[0]

    @staticmethod
    def _weights(program: Program, turnover: float, names: dict, x: np.ndarray, at: np.ndarray):
        """The weights that multipliers at (one row) ask for, their curvature, slope without costs, and step."""
        width = x.shape[1]
        h = np.where(names["upper"] > names["lower"], names["own"], 1.0)
        lin = names["mu"] + program.shrinkage * names["reference"]
        slope = lin - x @ at[:width]
        step = _Step(names, program, turnover)
        of_budget, of_turnover, of_gross = at[width:]
        return step.nearest(slope / h, h, of_turnover, of_gross, of_budget), h, lin, slope, step

    def at(self, turnover: float, several: np.ndarray) -> tuple[np.ndarray, _Sums]:
        """Dual values at several multipliers (a row each), and the sums at the first of them."""
        program, width, k = self.program, self.n_days, len(several)
        size, weights = width + 3, self._weights
        sent = self.rows.sparkSession.sparkContext.broadcast(several)

        def made(names: dict, x: np.ndarray) -> np.ndarray:
            values, first = np.zeros(k), None
            for j, at in enumerate(sent.value):
                w, h, lin, slope, step = weights(program, turnover, names, x, at)
                of_budget, of_turnover, of_gross = at[width:]
                d = w - names["previous"]
                curve, cost = float(0.5 * (h * w) @ w), step.cost(w)
                values[j] = curve - slope @ w + cost + of_budget * w.sum() + of_turnover * np.abs(d).sum() + of_gross * np.abs(w).sum()
                if first is None:
                    free = (w > names["lower"]) & (w < names["upper"]) & (d != 0) & ((w != 0) | (of_gross == 0))
                    c = np.column_stack([x[free], np.ones(free.sum()), np.sign(d[free]), np.sign(w[free])])
                    held = np.r_[x.T @ w, w.sum(), np.abs(d).sum(), np.abs(w).sum()]
                    squares = 0.5 * program.shrinkage * float(names["reference"] @ names["reference"])
                    first = np.r_[curve - lin @ w + cost, squares, held, ((c / h[free, None]).T @ c).ravel()]
            return np.r_[values, first]

        total = self._added(made, k + 2 + size + size * size)
        sent.unpersist()
        caps = np.array([program.budget, turnover, program.gross])
        values = total[:k] - several[:, width:] @ np.where(np.isfinite(caps), caps, 0.0)
        if width:
            values -= (several[:, :width] ** 2).sum(axis=1) / (2 * self.share)
        base, squares, rest = total[k], total[k + 1], total[k + 2 :]
        held = rest[:size]
        base += 0.5 * self.share * float(held[:width] @ held[:width])
        return values + squares, _Sums(float(values[0] + squares), float(base + squares), held, rest[size:].reshape(size, size))

    def solved(self, turnover: float) -> tuple[np.ndarray, _Sums, float, int] | None:
        """Multipliers, sums, the gap and the number of steps; nothing if steps don't get there."""
        program, width = self.program, self.n_days
        caps = np.array([program.budget, turnover, program.gross])
        capped, right = np.isfinite(caps), np.where(np.isfinite(caps), caps, 0.0)
        at, steps = np.zeros(width + 3), 0
        _, now = self.at(turnover, at[None])
        lengths = 0.3 ** np.arange(40)
        while True:
            over = now.held[width:] - right
            kept = abs(over[0]) <= 1e-10 * max(1.0, abs(program.budget)) and all(not c or x <= 1e-10 * max(1.0, r) for x, r, c in zip(over[1:], right[1:], capped[1:], strict=True))
            gap = max(0.0, now.base - now.dual)
            if kept and gap <= 1e-12 * (1 + abs(now.base)):
                return at, now, gap, steps
            slope = np.r_[now.held[:width] - at[:width] / self.share if width else [], over]
            moving = np.r_[np.ones(width + 1, bool), capped[1:] & ((at[width + 1 :] > 0) | (over[1:] > 0))]
            curve = now.curve.copy()
            curve[np.arange(width), np.arange(width)] += 1 / self.share if width else 0.0
            own = np.diag(curve)
            # multipliers that no free name follows, or all follow alike, go far, and the step is shortened
            curve = curve + np.diag(np.where(own > 0, 1e-9 * own, 1e-3 * max(own.max(initial=0.0), 1e-300)))
            step = np.zeros(width + 3)
            step[moving] = np.linalg.solve(curve[np.ix_(moving, moving)], slope[moving])
            several = at + lengths[:, None] * step
            several[:, width + 1 :] = np.maximum(several[:, width + 1 :], 0.0)
            values, new = self.at(turnover, several)
            enough = values >= now.dual + 1e-4 * ((several - at) @ slope) - 1e-14 * (1 + abs(now.dual))
            steps += 1
            if not enough.any() or steps >= 100:
                return (at, now, gap, steps) if kept and gap <= program.tolerance * (1 + abs(now.base)) else None
            best = 0 if enough[0] else int(np.argmax(values))
            if best:
                _, new = self.at(turnover, several[best : best + 1])
            at, now = several[best], new

    def weights(self, turnover: float, at: np.ndarray | None) -> DataFrame:
        """(instrument, weight), of the multipliers, or else as before."""
        program, width, weights = self.program, self.n_days, self._weights

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for r in range(b.num_rows):
                    table = np.frombuffer(b["given"][r].as_py()).reshape(len(GIVEN), -1)
                    names = dict(zip(GIVEN, table, strict=True))
                    x = np.frombuffer(b["x"][r].as_py()).reshape(table.shape[1], width)
                    w = names["previous"] if at is None else weights(program, turnover, names, x, at)[0]
                    yield pa.RecordBatch.from_arrays([b["instrument"].slice(r, 1).flatten(), pa.array(w)], names=["instrument", "weight"])

        found = self.rows.mapInArrow(run, f"instrument {self.kind}, weight double")
        return self.rows.sparkSession.createDataFrame(found.toArrow(), found.schema)  # one number per instrument

    def done(self) -> None:
        self.kept.unpersist()


def _by_multipliers(names: DataFrame, cov: Shrunk, program: Program) -> Solution | None:
    """Nothing where the dual isn't smooth or steps fail."""
    dual = _Dual(names, cov, program)
    try:
        turnover, fallbacks = _allowed(dual.bounds(), program)
        if math.isnan(turnover) or not dual.n:
            return Solution(dual.weights(turnover, None), "held", math.nan, math.nan, 0, [*fallbacks, "degenerate_rebalance"])
        found = dual.solved(turnover) if dual.curved() else None
        if found is None:
            return None
        at, sums, gap, steps = found
        return Solution(dual.weights(turnover, at), "relaxed" if fallbacks else "optimal", sums.base, gap, steps, fallbacks)
    finally:
        dual.done()


def _steps(step: _Step, matrix: Pairs | Factors, n: int, b: np.ndarray, pull: np.ndarray, push: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Accelerated proximal steps with multipliers pull and weight push on B'w; returns w, Cw, the gap and the steps."""
    q, names = step.program, step.names
    value = lambda w, cw: 0.5 * q.risk_aversion * w @ cw - names["mu"] @ w + 0.5 * q.shrinkage * ((w - names["reference"]) ** 2).sum() + pull @ (b.T @ w) + 0.5 * push * ((b.T @ w) ** 2).sum()
    slope = lambda w, cw: q.risk_aversion * cw - names["mu"] + q.shrinkage * (w - names["reference"]) + b @ (pull + push * (b.T @ w))
    w = step.projected(start, 1.0)[0]
    cw = matrix.times(w)
    z, cz, t, length = w, cw, 1.0, q.risk_aversion * max(float(names["variance"].max(initial=0.0)), 1e-12) + q.shrinkage + push * float((b**2).sum(axis=1).max(initial=0.0))
    gap, count = math.inf, 0
    while count < q.most_steps:
        g, base = slope(z, cz), value(z, cz)
        while True:
            new, multipliers = step.projected(z - g / length, length)
            c_new = matrix.times(new)
            count += 1
            d = new - z
            if value(new, c_new) <= base + g @ d + 0.5 * length * d @ d + 1e-14 * (1 + abs(base)):
                break
            length *= 2
        at_new = slope(new, c_new)
        gap = float(at_new @ new + step.cost(new)) - step.least_linear(at_new, multipliers)
        if gap <= q.tolerance * (1 + abs(value(new, c_new))):
            return new, c_new, gap, count
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if (z - new) @ (new - w) > 0:  # the momentum points uphill: begin anew
            after, t = 1.0, 1.0
        momentum = (t - 1) / after
        z, cz = new + momentum * (new - w), c_new + momentum * (c_new - cw)
        w, cw, t = new, c_new, after
    return w, cw, gap, count


def mean_variance(names: DataFrame, cov: DataFrame | Shrunk, program: Program = Program(), *, exposures: DataFrame | None = None) -> Solution:
    """Weights of one rebalance. names: (instrument, mu, previous, lower, upper) and, if wanted, reference (else 0), tradable
    (what isn't is held at 0) and capacity (the most that may be traded of it). cov: (a, b, cov), a <= b, positive semidefinite (see
    risk.psd_repair), or a shrunk one by its factors; names without pairs have no risk. exposures: (instrument, factor, exposure), whose sums are to be 0.

    Where nothing is allowed the caps give way in order: the turnover cap by half of itself, then neutrality becomes a penalty on
    its absolute sums, and at last the previous weights are held.
    """
    have = set(names.columns)
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)).cast("double") if c in have else F.lit(float(default))
    lower, upper, previous = F.col("lower").cast("double"), F.col("upper").cast("double"), col("previous", 0.0)
    if "capacity" in have:
        near = F.coalesce(F.col("capacity").cast("double"), F.lit(0.0))
        lower, upper = F.greatest(lower, previous - near), F.least(upper, previous + near)
    if "tradable" in have:
        closed = ~F.coalesce(F.col("tradable"), F.lit(False))
        lower, upper = F.when(closed, 0.0).otherwise(lower), F.when(closed, 0.0).otherwise(upper)
    names = names.select("instrument", col("mu", 0.0).alias("mu"), previous.alias("previous"), lower.alias("lower"), upper.alias("upper"), col("reference", 0.0).alias("reference"))
    if isinstance(cov, Shrunk) and exposures is None and (found := _by_multipliers(names, cov, program)):
        return found
    table = names.orderBy("instrument").collect()
    labels = [r.instrument for r in table]
    n, spark = len(labels), names.sparkSession
    values = {c: np.array([r[c] for r in table], float) for c in ("mu", "previous", "lower", "upper", "reference")}
    kind = names.schema["instrument"].dataType.simpleString()
    out = lambda w: spark.createDataFrame(list(zip(labels, map(float, w), strict=True)), f"instrument {kind}, weight double")
    held = lambda why: Solution(out(values["previous"]), "held", math.nan, math.nan, 0, [*why, "degenerate_rebalance"])
    turnover, fallbacks = _allowed(bounds_of(values), program)
    if math.isnan(turnover) or not n:
        return held(fallbacks)
    numbers = spark.createDataFrame(list(zip(labels, range(n), strict=True)), f"name {kind}, k bigint")
    matrix = (Factors if isinstance(cov, Shrunk) else Pairs)(cov, numbers, n)
    try:
        values["variance"] = matrix.variance
        step = _Step(values, program, turnover)
        b, kept = _exposed(exposures, numbers, n), 0.0
        pull, scale = np.zeros(b.shape[1]), max(1.0, float(np.abs(b).max(initial=0.0)))
        push = (program.risk_aversion * float(values["variance"].max(initial=1.0)) + program.shrinkage + 1.0) if b.shape[1] else 0.0
        w, steps, last, soft, turns = values["previous"], 0, math.inf, False, 0
        while True:
            w, cw, gap, more = _steps(step, matrix, n, b, pull, push, w)
            steps += more
            kept = float(np.abs(b.T @ w).max(initial=0.0))
            if kept <= 1e-9 * scale:
                break
            moved = pull + push * (b.T @ w)
            if soft:
                moved = np.clip(moved, -program.neutrality_penalty, program.neutrality_penalty)
                if np.abs(moved - pull).max() <= 1e-10 * (1 + program.neutrality_penalty):
                    break
            turns += 1
            if not soft and (turns >= 60 or np.abs(moved).max() > 1e6):
                soft, moved = True, np.clip(moved, -program.neutrality_penalty, program.neutrality_penalty)
                fallbacks.append("neutrality")
            elif soft and turns >= 200:
                return held(fallbacks)
            push = min(push * 2, 1e4 * (1 + push)) if kept > 0.5 * last and not soft else push
            pull, last = moved, kept
    finally:
        matrix.done()
    objective = 0.5 * program.risk_aversion * w @ cw - values["mu"] @ w + 0.5 * program.shrinkage * ((w - values["reference"]) ** 2).sum() + step.cost(w)
    return Solution(out(w), "relaxed" if fallbacks else "optimal", float(objective), float(gap), steps, fallbacks)


def _exposed(exposures: DataFrame | None, numbers: DataFrame, n: int) -> np.ndarray:
    """One row per instrument, one column per factor."""
    if exposures is None:
        return np.zeros((n, 0))
    found = exposures.join(numbers, F.col("instrument") == F.col("name")).select("k", "factor", F.col("exposure").cast("double").alias("x")).collect()
    factors = {f: i for i, f in enumerate(sorted({r.factor for r in found}))}
    b = np.zeros((n, len(factors)))
    for r in found:
        b[r.k, factors[r.factor]] += r.x
    return b
