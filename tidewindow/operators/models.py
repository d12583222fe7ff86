"""Walk-forward models of all folds at once, fitted on mergeable moments.

A test fold is fitted on the folds before it.  What the preparation needs (counts, sums, ranges,
medians, modes) is gathered once per fold and added up along the folds; what a fit needs is a weighted
Gram matrix per (test fold, model), summed by the tasks where the rows lie.  One pass over the rows
serves every fold and every model that is not settled; only matrices reach the driver.

The category with most levels (instruments grow with the data) is never made dense columns: its block
of a Gram matrix is a diagonal, so a level is one row of sums that tasks add up by key, and its weights
are eliminated exactly.  A quantile fit needs few of its levels: the slope of one is at most its share of the
rows times max(q, 1 - q), and where that stays below PENALTY its weight is zero at the optimum.

* Huber: sum(s + H(r / s) s) + ALPHA |w|^2 with its scale s, by reweighted steps.
* Quantile: mean check loss + PENALTY |w|_1, by reweighted steps whose quadratic bound is solved
  with soft-thresholding; a fit is settled when its duality gap is below GAP or, where the optimum
  is so flat that the dual values lag behind, when ten steps gain less than GAIN of the spread.
* Splines: ridge on a standardised cubic basis of every numeric column: one pass.
"""

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewindow.operators.chunks import value_bin
from tidewindow.sources.staging import stage

# Fixed values of the studied models.
EPSILON, ALPHA, PENALTY, RIDGE = 1.35, 1.0, 0.1, 10.0
QUANTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}
KNOTS, DEGREE = 5, 3

GAP = 1e-5
GAIN = 1e-6
CALM = 0.1
TOLERANCE = 1e-4
STEPS = 1000
SWEEPS = 60
FEW = 32
DENSE = 1000  # values of a category that becomes dense columns
LEVELS = 1_000_000  # values of any category: the driver holds a weight for each


class Fold(NamedTuple):
    """What a test fold's training rows say about the columns."""

    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mode: list


def prefix_medians(long: DataFrame, tests: DataFrame) -> DataFrame:
    """(predictor, test, median) of ``long`` (predictor, fold, x) over the folds before each test.

    Rows are counted into order-preserving bins per fold; a test adds the bins of its folds and
    looks only at the values of the bins that hold its middle ranks.
    """
    rows = long.withColumn("bin", value_bin(F.col("x")))
    before = F.col("fold") < F.col("test")

    def along(counts, keys, order):
        merged = counts.join(tests, before).groupBy("predictor", "test", *keys).agg(F.sum("n").alias("n"))
        w = Window.partitionBy("predictor", "test").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return merged.withColumn("upto", F.sum("n").over(w))

    bins = along(rows.groupBy("predictor", "fold", "bin").agg(F.count("*").alias("n")), ["bin"], "bin")
    total = F.sum("n").over(Window.partitionBy("predictor", "test"))
    bins = bins.withColumn("total", total).withColumns({"lo": F.floor((F.col("total") - 1) / 2), "hi": F.floor(F.col("total") / 2)})
    start = F.col("upto") - F.col("n")
    middle = bins.where((start <= F.col("hi")) & (F.col("upto") > F.col("lo"))).select(
        "predictor", "test", F.col("bin").alias("of"), start.alias("start"), "lo", "hi"
    )
    values = rows.groupBy("predictor", "fold", "bin", "x").agg(F.count("*").alias("n"))
    wanted = F.broadcast(middle)  # at most two bins per test and predictor
    near = values.join(wanted.withColumnRenamed("predictor", "p"), (F.col("predictor") == F.col("p")) & (F.col("bin") == F.col("of")) & before)
    near = near.groupBy("predictor", "test", "of", "start", "lo", "hi", "x").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("predictor", "test", "of").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("to", F.col("start") + F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n"))
    holds = lambda rank: (F.col("from") <= F.col(rank)) & (F.col(rank) < F.col("to"))
    return near.groupBy("predictor", "test").agg(
        ((F.max(F.when(holds("lo"), F.col("x"))) + F.max(F.when(holds("hi"), F.col("x")))) / 2).alias("median")
    )


def prepare(rows: DataFrame, numeric, categorical, fold: str, tests) -> tuple[dict[int, Fold], list[list]]:
    """({test fold: Fold}, the levels of each category) from one row per fold and per level."""
    spark = rows.sparkSession
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(numeric):
        x = F.col(c).cast("double")
        aggs += [f(y).alias(f"{n}{i}") for n, f, y in (("n", F.count, x), ("s", F.sum, x), ("q", F.sum, x * x), ("a", F.min, x), ("b", F.max, x))]
    stats = {r["f"]: r for r in rows.groupBy(F.col(fold).alias("f")).agg(*aggs).collect()}
    long = rows.select(
        F.col(fold).alias("fold"), F.inline(F.array(*[F.struct(F.lit(i).alias("predictor"), F.col(c).cast("double").alias("x")) for i, c in enumerate(numeric)]))
    ).where(F.col("x").isNotNull())
    known = spark.createDataFrame([(int(t),) for t in tests], "test long")
    medians = {(r["test"], r["predictor"]): r["median"] for r in prefix_medians(long, known).collect()}
    counts, held = [], []
    for c in categorical:
        found = rows.groupBy(F.col(fold).alias("f"), F.col(c).alias("v")).agg(F.count("*").alias("n")).where("v is not null")
        held.append(found.select("v").distinct().limit(LEVELS + 1).count())
        if held[-1] > LEVELS:
            raise ValueError(f"{c} has more than {LEVELS} values")
        counts.append(found.collect())
    for c, n in sorted(zip(categorical, held), key=lambda x: x[1])[:-1]:
        if n > DENSE:
            raise ValueError(f"{c} has more than {DENSE} values, and is not the largest category")
    levels = [sorted({r["v"] for r in found}) for found in counts]
    out = {}
    for t in tests:
        seen = [r for f, r in stats.items() if f < t]
        total = sum(r["rows"] for r in seen)
        if not total:
            continue
        cells = []
        for i in range(len(numeric)):
            part = [r for r in seen if r[f"n{i}"]]
            n, med = sum(r[f"n{i}"] for r in part), medians.get((t, i), 0.0)
            s, q = sum(r[f"s{i}"] for r in part), sum(r[f"q{i}"] for r in part)
            ends = [r[f"a{i}"] for r in part] + [r[f"b{i}"] for r in part] + ([med] if n < total else [])
            mean = (s + (total - n) * med) / total
            spread = (q + (total - n) * med**2) / total - mean**2
            cells.append((med, mean, np.sqrt(spread) if spread > 1e-12 * max(1.0, mean**2) else 1.0, min(ends), max(ends)))
        modes = []
        for found in counts:
            votes = {}
            for r in found:
                if r["f"] < t:
                    votes[r["v"]] = votes.get(r["v"], 0) + r["n"]
            modes.append(min(votes, key=lambda v: (-votes[v], v)) if votes else None)
        out[t] = Fold(*(np.array(c) for c in zip(*cells)), modes)
    return out, levels


def spline_basis(x: np.ndarray, low: float, high: float, knots: int = KNOTS, degree: int = DEGREE) -> np.ndarray:
    """Cox-de Boor basis on evenly spaced knots, constant beyond them; a constant column has none."""
    places = np.arange(knots + degree - 1)
    if not high > low:
        return np.zeros((len(x), len(places)))
    v = np.clip((x - low) / (high - low), 0, 1)[:, None] * (knots - 1) - places + degree
    basis = [((v >= j) & (v < j + 1)).astype(float) for j in range(degree + 1)]
    for k in range(1, degree + 1):
        basis = [((v - j) * a + (j + k + 1 - v) * b) / k for j, (a, b) in enumerate(zip(basis, basis[1:]))]
    return basis[0]


class Block:
    """A batch's columns as arrays, and its design matrices for any test fold; the last category stays codes."""

    def __init__(self, batch, levels):
        self.size = batch.num_rows
        self.x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(self.size, -1)
        self.fold = batch.column("fold").to_numpy(zero_copy_only=False)
        self.codes = []
        for i, known in enumerate(levels):
            place = {v: j for j, v in enumerate(known)}
            self.codes.append(np.array([place.get(v, -1) for v in batch.column(f"c{i}").to_pylist()]))
        self.levels = levels

    def _filled(self, p: Fold, rows):
        x = self.x[rows]
        return np.where(np.isnan(x), p.median, x)

    def _known(self, p: Fold, rows, i: int):
        null = self.levels[i].index(p.mode[i]) if p.mode[i] is not None else -1
        return np.where(self.codes[i][rows] < 0, null, self.codes[i][rows])

    def _hot(self, p: Fold, rows):
        dense = range(len(self.levels) - 1)
        return [(self._known(p, rows, i)[:, None] == np.arange(len(self.levels[i]))).astype(float) for i in dense]

    def wide(self, p: Fold, rows):
        """Codes of the last category; -1 without one."""
        return self._known(p, rows, -1) if self.levels else np.full(rows.sum(), -1)

    def linear(self, p: Fold, rows):
        return np.hstack([(self._filled(p, rows) - p.mean) / p.scale, *self._hot(p, rows), np.ones((rows.sum(), 1))])

    def splines(self, p: Fold, rows):
        x = self._filled(p, rows)
        basis = [spline_basis(x[:, i], p.low[i], p.high[i]) for i in range(x.shape[1])]
        return np.hstack([*basis, *self._hot(p, rows), np.ones((rows.sum(), 1))])


class Fit(NamedTuple):
    """A model as a pass needs it: its kind, its current solution, and the kind's width (scale or smoothing).

    ``wide`` are weights of the last category's levels; a quantile fit has ``keep`` instead, the few levels
    that are columns before the constant."""

    kind: str
    solution: np.ndarray | None
    width: float
    wide: np.ndarray | None = None
    keep: tuple = ()


def _by_level(codes, table, weight, out):
    """Adds the weighted rows of ``table`` to the rows of ``out`` that their codes name."""
    rows = np.flatnonzero(codes >= 0)
    rows = rows[np.argsort(codes[rows], kind="stable")]
    if len(rows):
        found, start = np.unique(codes[rows], return_index=True)
        out[found] += np.add.reduceat(table[rows] * weight[rows, None], start, axis=0)


def _sums(z, y, fit: Fit, codes=None, out=None):
    """Weighted moments of (columns, 1, target), and three figures of the kind; into ``out`` those by level."""
    table = np.column_stack([z, y])
    if fit.solution is None:
        if out is not None:
            _by_level(codes, table, np.ones(len(y)), out)
        return np.append(table.T @ table, [0.0, 0.0, 0.0])
    r = y - z @ fit.solution
    if fit.wide is not None:
        r = r - np.where(codes >= 0, np.append(fit.wide, 0.0)[codes], 0.0)
    size = np.abs(r)
    if fit.kind == "huber":
        inside = size <= EPSILON * fit.width
        weight = np.where(inside, 1.0, EPSILON * fit.width / np.maximum(size, 1e-300))
        more = [(r[inside] ** 2).sum(), (~inside).sum(), len(r)]
    else:
        weight = 1 / np.maximum(size, fit.width)
        q = QUANTILES[fit.kind]
        more = [np.maximum(q * r, (q - 1) * r).sum(), 0.0, len(r)]
    if out is not None:
        _by_level(codes, table, weight, out)
    return np.append((table * weight[:, None]).T @ table, more)


def _dense(kind: str, levels, numeric: int) -> int:
    """How many columns a design has before the constant, without the last category."""
    return sum(map(len, levels[:-1])) + numeric * (KNOTS + DEGREE - 1 if kind == "splines" else 1)


def _by_levels(plan):
    """The fits of ``plan`` that need sums by level of the last category, in order."""
    return [(t, fit) for t, fits in plan.items() for fit in fits if fit.kind not in QUANTILES]


def _moments(batches, levels, folds, plan):
    total, sums = None, {}
    wanted = _by_levels(plan) if levels else []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = Block(batch, levels)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for t, fit in wanted:
            if (t, fit.kind) not in sums:
                sums[t, fit.kind] = np.zeros((len(levels[-1]), _dense(fit.kind, levels, block.x.shape[1]) + 2))
        parts = []
        for t, fits in plan.items():
            rows = block.fold < t
            made, codes = {}, block.wide(folds[t], rows)
            for fit in fits:
                shape = "splines" if fit.kind == "splines" else "linear"
                if shape not in made:
                    made[shape] = getattr(block, shape)(folds[t], rows)
                z = made[shape]
                if fit.keep:
                    z = np.hstack([z[:, :-1], (codes[:, None] == np.array(fit.keep)).astype(float), z[:, -1:]])
                parts.append(_sums(z, y[rows], fit, codes, sums.get((t, fit.kind))))
        now = np.concatenate(parts)
        total = now if total is None else total + now
    if total is None:
        return
    schema = ["level", "moments"]
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema)
    if wanted:
        held = np.flatnonzero(np.any([a.any(axis=1) for a in sums.values()], axis=0))
        for some in np.array_split(held, len(held) // 1024 + 1):
            flat = np.hstack([sums[t, fit.kind][some] for t, fit in wanted])
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([r.tobytes() for r in flat], pa.binary())], schema)


class Moments(NamedTuple):
    gram: np.ndarray  # of the columns and the constant
    cross: np.ndarray  # with the target
    target: float
    figures: np.ndarray
    wide: np.ndarray | None = None  # by level of the last category: sums of the columns, the constant and the target


def gathered(rows: DataFrame, levels, folds, plan) -> dict:
    """{(test, kind): Moments} of one pass for every fit of ``plan`` ({test: [Fit]})."""
    parts = rows.mapInArrow(partial(_moments, levels=levels, folds=folds, plan=plan), "level long, moments binary")
    numeric, wanted = len(next(iter(folds.values())).median), _by_levels(plan) if levels else []
    found = {}
    if wanted:
        # A row a level: added by key where they lie, so the driver gets each level once.
        found = dict(parts.rdd.map(lambda r: (r[0], np.frombuffer(r[1]))).reduceByKey(np.add).collect())
        flat = found.pop(-1)
    # One row a task: few tasks' matrices are added here, many are added on executors first.
    elif rows.rdd.getNumPartitions() <= FEW:
        flat = np.sum([np.frombuffer(r[1]) for r in parts.collect()], axis=0)
    else:
        flat = parts.rdd.map(lambda r: np.frombuffer(r[1])).treeReduce(np.add)
    wide, at = {}, 0
    for t, fit in wanted:
        side = _dense(fit.kind, levels, numeric) + 2
        held = np.zeros((len(levels[-1]), side))
        for level, row in found.items():
            held[level] = row[at : at + side]
        wide[t, fit.kind], at = held, at + side
    out, at = {}, 0
    for t, fits in plan.items():
        for fit in fits:
            side = _dense(fit.kind, levels, numeric) + len(fit.keep) + 2
            m = flat[at : at + side * side].reshape(side, side)
            figures = flat[at + side * side :][:3]
            out[t, fit.kind] = Moments(m[:-1, :-1], m[:-1, -1], m[-1, -1], figures, wide.get((t, fit.kind)))
            at += side * side + 3
    return out


def solved(m: Moments, penalty: np.ndarray, wide_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (of the columns, of the last category's levels) under quadratic penalties.

    Levels exclude each other, so their block is a diagonal and is eliminated exactly.
    """
    if m.wide is None:
        return np.linalg.lstsq(m.gram + np.diag(penalty), m.cross, rcond=None)[0], np.zeros(0)
    across, target = m.wide[:, :-1], m.wide[:, -1]
    held = across[:, -1] + wide_penalty
    share = across / held[:, None]
    v = np.linalg.lstsq(m.gram + np.diag(penalty) - across.T @ share, m.cross - share.T @ target, rcond=None)[0]
    return v, (target - across @ v) / held


def ridge(m: Moments, scaled: int) -> tuple[np.ndarray, np.ndarray]:
    """Ridge with a free constant, of the first ``scaled`` columns standardised, the others as they are."""
    n = m.gram[-1, -1]
    mean = m.gram[-1, :scaled] / n
    spread = np.diag(m.gram)[:scaled] / n - mean**2
    penalty = np.full(len(m.gram), RIDGE)
    penalty[:scaled] *= np.where(spread > 1e-12 * np.maximum(1.0, mean**2), spread, 1.0)
    penalty[-1] = 0.0
    return solved(m, penalty, RIDGE)


def with_levels(m: Moments, keep) -> Moments:
    """``m`` with columns of the levels ``keep`` before its constant."""
    if not keep:
        return m._replace(wide=None)
    part, last = m.wide[list(keep)], len(m.gram) - 1
    at = [*range(last), *range(last + 1, last + 1 + len(keep)), last]
    gram = np.block([[m.gram, part[:, :-1].T], [part[:, :-1], np.diag(part[:, -2])]])
    return Moments(gram[np.ix_(at, at)], np.append(m.cross, part[:, -1])[at], m.target, m.figures)


def possible_levels(m: Moments, q: float) -> tuple:
    """Levels whose weight in a quantile fit may differ from zero: a slope beyond the penalty is possible."""
    if m.wide is None:
        return ()
    share = m.wide[:, -2] / m.gram[-1, -1]
    return tuple(np.flatnonzero(share * max(q, 1 - q) >= PENALTY * (1 - 1e-9)).tolist())


def soft_threshold(q: np.ndarray, c: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Towards the argmin of v'Qv/2 - c'v + penalty |v but its last|_1, by coordinate descent.

    Every sweep lowers the bound, which is all a reweighted step needs, so sweeps are few.
    """
    v = start.copy()
    pull = c - q @ v
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(len(v)):
            if q[j, j] <= 1e-14:
                continue
            old, z = v[j], pull[j] + q[j, j] * v[j]
            v[j] = z / q[j, j] if j == len(v) - 1 else np.sign(z) * max(abs(z) - penalty, 0.0) / q[j, j]
            if v[j] != old:
                pull += q[:, j] * (old - v[j])
                most = max(most, abs(v[j] - old) * np.sqrt(q[j, j]))
        if most < 1e-9:
            break
    return v


class QuantileState:
    """Steps of one quantile fit; ``settled`` by the gap between its objective and a dual bound."""

    def __init__(self, kind: str, plain: Moments):
        self.kind, self.q, self.levels = kind, QUANTILES[kind], 0 if plain.wide is None else len(plain.wide)
        self.keep = possible_levels(plain, self.q)
        self.plain = plain = with_levels(plain, self.keep)
        n = plain.gram[-1, -1]
        mean = plain.cross[-1] / n
        self.floor = max(np.sqrt(max(plain.target / n - mean**2, 0.0)), 1e-12)
        self.width, self.solution, self.settled = self.floor, np.append(np.zeros(len(plain.cross) - 1), mean), False
        self.values = []

    def fit(self):
        return Fit(self.kind, self.solution, self.width, None, self.keep)

    def weights(self):
        last, wide = len(self.solution) - 1 - len(self.keep), np.zeros(self.levels)
        wide[list(self.keep)] = self.solution[last:-1]
        return np.append(self.solution[:last], self.solution[-1]), wide

    def take(self, m: Moments):
        n, v, tilt = m.figures[2], self.solution, self.q - 0.5
        lift = m.cross - m.gram @ v  # the columns times the weighted residuals
        slope = (tilt * self.plain.gram[-1] + lift / 2) / n
        value = m.figures[0] / n + PENALTY * np.abs(v[:-1]).sum()
        # The smoothed loss's slopes are dual values; scaled into bounds they bound the optimum from below.
        scale = min(1.0, PENALTY / max(np.abs(slope[:-1]).max(initial=0.0), 1e-300))
        against = (tilt * self.plain.cross[-1] + (m.target - v @ m.cross) / 2) / n
        bound = scale * (against - slope[-1] * v[-1])
        self.gap = value - bound
        self.values.append(value)
        narrow = self.width <= self.floor * 1e-5
        flat = narrow and len(self.values) > 10 and self.values[-11] - value < GAIN * self.floor
        if flat or (self.gap <= GAP * max(1.0, self.floor) and self.width <= self.floor * 1e-3):
            self.settled = True
            return
        self.solution = soft_threshold(m.gram / (2 * n), m.cross / (2 * n) + tilt * self.plain.gram[-1] / n, PENALTY, v)
        # The smoothing narrows only once steps are small against it: narrowed sooner, the steps jam short of the optimum.
        step = self.solution - v
        if step @ self.plain.gram @ step <= n * (CALM * self.width) ** 2:
            self.width = max(self.width * 0.5, self.floor * 1e-6)


class HuberState:
    """Steps of one Huber fit with its scale."""

    kind = "huber"

    def __init__(self, plain: Moments):
        n = plain.gram[-1, -1]
        self.solution = np.append(np.zeros(len(plain.cross) - 1), plain.cross[-1] / n)
        self.floor = max(np.sqrt(max(plain.target / n - self.solution[-1] ** 2, 0.0)), 1e-12)
        self.scale, self.settled = self.floor, False
        self.wide = None if plain.wide is None else np.zeros(len(plain.wide))

    def fit(self):
        return Fit(self.kind, self.solution, self.scale, self.wide)

    def weights(self):
        return self.solution, np.zeros(0) if self.wide is None else self.wide

    def take(self, m: Moments):
        square, out, n = m.figures
        rest = n - out * EPSILON**2
        last = np.concatenate([*self.weights(), [self.scale]])
        penalty = np.append(np.full(len(self.solution) - 1, ALPHA * self.scale), 0.0)
        self.solution, wide = solved(m, penalty, ALPHA * self.scale)
        self.wide = None if self.wide is None else wide
        self.scale = max(np.sqrt(square / rest) if rest > 0 else self.scale / 2, self.floor * 1e-9)
        moved = np.abs(np.concatenate([*self.weights(), [self.scale]]) - last).max()
        self.settled = moved <= TOLERANCE * max(1e-9, np.abs(last).max())


def fitted(rows: DataFrame, levels, folds: dict[int, Fold]) -> dict:
    """{(test, kind): (weights of the columns, of the last category's levels)}; a fit that has not settled after STEPS passes is an error."""
    first = gathered(rows, levels, folds, {t: [Fit("huber", None, 0.0), Fit("splines", None, 0.0)] for t in folds})
    scaled = len(next(iter(folds.values())).median) * (KNOTS + DEGREE - 1)
    out = {(t, "splines"): ridge(first[t, "splines"], scaled) for t in folds}
    states = {(t, "huber"): HuberState(first[t, "huber"]) for t in folds}
    states |= {(t, k): QuantileState(k, first[t, "huber"]) for t in folds for k in QUANTILES}
    for _ in range(STEPS):
        plan = {}
        for (t, _), state in states.items():
            if not state.settled:
                plan.setdefault(t, []).append(state.fit())
        if not plan:
            return out | {key: state.weights() for key, state in states.items()}
        for key, m in gathered(rows, levels, folds, plan).items():
            states[key].take(m)
    raise ValueError(f"fits {[k for k, s in states.items() if not s.settled]} have not settled after {STEPS} steps")


FAMILIES = ("huber", "quantile_q25", "quantile_q50", "quantile_q75", "quantile", "additive_splines")


def _scores(batches, levels, folds, fits, keep):
    for batch in batches:
        block = Block(batch, levels)
        scores = np.full((block.size, len(FAMILIES)), np.nan)
        for t in set(block.fold.tolist()) & set(folds):
            rows = block.fold == t
            z, s = block.linear(folds[t], rows), block.splines(folds[t], rows)
            codes = block.wide(folds[t], rows)

            def score(design, kind):
                weights, wide = fits[t, kind]
                return design @ weights + np.where(codes >= 0, np.append(wide, 0.0)[codes], 0.0)

            middle = np.column_stack([score(z, k) for k in QUANTILES])
            scores[rows] = np.column_stack([score(z, "huber"), middle, np.median(middle, axis=1), score(s, "splines")])
        lists = pa.ListArray.from_arrays(np.arange(block.size + 1, dtype=np.int32) * len(FAMILIES), scores.ravel())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("fold"), lists], [*keep, "fold", "scores"])


def walk_forward(rows: DataFrame, numeric, categorical, target: str, fold: str, tests, keep) -> DataFrame:
    """(keep, fold, score, family): out-of-sample scores, every fit on earlier folds only.

    Nulls take the training rows' median or most frequent value; a category not seen in training
    adds nothing.  A fold without earlier rows cannot be scored and has no rows.
    """
    x = F.array(*[F.col(c).cast("double") for c in numeric])
    x = F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan"))))
    folds, levels = prepare(rows, numeric, categorical, fold, tests)
    # The category with most levels goes last.
    order = sorted(range(len(levels)), key=lambda i: len(levels[i]))
    levels = [levels[i] for i in order]
    folds = {t: p._replace(mode=[p.mode[i] for i in order]) for t, p in folds.items()}
    cats = [F.col(categorical[i]).cast("string").alias(f"c{at}") for at, i in enumerate(order)]
    base = stage(rows.select(*[F.col(c) for c in keep], F.col(fold).cast("long").alias("fold"), x.alias("x"), F.col(target).cast("double").alias("y"), *cats))
    schema = ", ".join(f"`{c}` {t}" for c, t in base.select(*keep).dtypes) + ", fold long, scores array<double>"
    if not folds:
        scored = base.limit(0).select(*keep, "fold", F.array(*[F.lit(None).cast("double")] * len(FAMILIES)).alias("scores"))
    else:
        known = base.where(F.col("fold").isin(*[int(t) for t in folds]))
        fits = fitted(base.select("fold", "x", "y", *[f"c{i}" for i in range(len(categorical))]), levels, folds)
        scored = known.mapInArrow(partial(_scores, levels=levels, folds=folds, fits=fits, keep=list(keep)), schema)
    items = F.array(*[F.struct(F.lit(name).alias("family"), F.col("scores")[i].alias("score")) for i, name in enumerate(FAMILIES)])
    return scored.select(*keep, "fold", F.inline(items))
