"""A support vector classifier with a radial kernel, as a linear one over random Fourier features (M-12).

A kernel matrix grows with the square of the rows. Instead each standardised
row is mapped to ``components`` cosines whose inner products approach the
kernel ``exp(-gamma |x - y|^2)``, and a linear hinge-loss model is fitted over
them. Probabilities come from Platt's logistic curve over margins of rows that
the fold's model has not seen.

The models of the folds and that of all rows are fitted side by side: one pass
over the rows answers the points at which all of them ask for loss and slope.
The rows are kept in blocks of ``BLOCK_ROWS``, dealt to tasks by their number,
and mapped anew in each pass, so that a row keeps its features only.
A task returns one small table of sums, which the driver adds up in
the order of the tasks. Objective, steps and stopping rule are those of
MLlib's ``LinearSVC``.

Frequencies come from a seed, folds from a hash of the key, so a run can be
repeated. Rows without a label or with a null or non-finite feature do not
train; a row that cannot be scored has the probability null.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterable, Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import dbl
from riskframe.operators.explain import Model, finite
from riskframe.session import dealt, written

COMPONENTS = 200
BLOCK_ROWS = 1 << 8  # mapped, they stay in a core's cache
TASK_ROWS = 1 << 15
ALL = -1  # in place of the fold that a model leaves out


def cosine(x: np.ndarray) -> np.ndarray:
    """cos(x) to float64 by the sine's series within a quarter turn, as whole-array steps."""
    turn = x / (2 * math.pi)
    with np.errstate(invalid="ignore"):
        y = 2 * math.pi * (0.25 - np.abs(turn - np.rint(turn)))
    square, out = y * y, np.full_like(y, 1 / math.factorial(21))
    for n in range(19, 0, -2):
        out *= square
        out += (-1 if n % 4 == 3 else 1) / math.factorial(n)
    out *= y
    return out


class FourierMap:
    """x to sqrt(2 / D) cos(W z + b), z the standardised row."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, components: int, gamma: float, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.deviation = mean, np.where(deviation > 0, deviation, 1.0)
        self.frequency = draw.standard_normal((len(mean), components)) * math.sqrt(2 * gamma)
        self.phase = draw.uniform(0, 2 * math.pi, components)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.deviation
        return math.sqrt(2 / len(self.phase)) * cosine(z @ self.frequency + self.phase)


class Block(NamedTuple):
    label: np.ndarray   # -1 or 1
    fold: np.ndarray
    x: np.ndarray       # a row's features a line


def _blocks(rows: DataFrame, features: list[str]) -> RDD:
    """The rows as blocks, in memory or on the executors' disks."""

    def run(part: Iterable[tuple]) -> Iterator[Block]:
        for some in batched(part, BLOCK_ROWS):
            x = np.array(some, np.float64)
            yield Block(2 * x[:, 0] - 1, x[:, 1].astype(np.int32), x[:, 2:])

    return dealt(rows.select("label", "fold", *features), TASK_ROWS).rdd.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)


def _total(blocks: RDD, shape: tuple[int, ...], measure) -> np.ndarray:
    """The sum of ``measure(block)`` over all blocks; one table of ``shape`` a task reaches the driver."""

    def run(part: Iterator[Block]) -> Iterator[np.ndarray]:
        out = np.zeros(shape)
        for block in part:
            out += measure(block)
        yield out

    return sum(blocks.mapPartitions(run).collect(), np.zeros(shape))


def _descent(size: int, max_iter: int, tolerance: float = 1e-6, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """A minimum from zero on, by quasi-Newton steps of limited memory that keep to their orthant: yields the points
    at which it needs (value, gradient), returns the last one."""
    x = np.zeros(size)
    value, grad = yield x
    first, seen, steps, failed = value, [math.inf], [], False
    for n in range(max_iter):
        if np.linalg.norm(grad) <= max(tolerance * value, 1e-8) or (n and abs(value - max(seen)) <= tolerance * first):
            break
        while True:
            to = _direction(grad, steps)
            if to is not None:
                to = np.where(to * grad < 0, to, 0.0)
                side = np.where(x != 0, np.sign(x), np.sign(-grad))
                slope, shrink = to @ grad, 0.1 if n == 0 else 0.5
                if slope == 0:
                    return x
                at = shrink * (0.5 / np.linalg.norm(grad) if n == 0 else 1.0)  # as in LinearSVC, the whole step is never taken
                for _ in range(19):
                    there = x + at * to
                    there = np.where(np.sign(there) == side, there, 0.0)
                    new, new_grad = yield there
                    along = new_grad @ to
                    if new > value + 1e-4 * at * slope or -0.9 * slope < along:
                        factor = shrink
                    elif along < 0.9 * slope:
                        factor = 2.1
                    else:
                        break
                    if not 1e-10 <= at * factor <= 1e10:
                        to = None
                        break
                    at *= factor
            if to is not None:
                break
            if failed:
                return x
            steps, failed = [], True  # once more, along the slope
        failed = False
        steps = [(there - x, new_grad - grad), *steps][:memory]
        x, value, grad = there, new, new_grad
        seen = [*seen, value][-20:]
    return x


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
    """Against the gradient, bent by the last steps (step, change of the gradient), newest first; None if they say nothing."""
    out, shares = grad.copy(), []
    with np.errstate(all="ignore"):
        for step, change in steps:
            shares.append(step @ out / (step @ change))
            out -= shares[-1] * change
        if steps:
            out *= steps[0][0] @ steps[0][1] / (steps[0][1] @ steps[0][1])
        for (step, change), share in zip(reversed(steps), reversed(shares), strict=True):
            out += (share - change @ out / (step @ change)) * step
    bad = steps and steps[0][0] @ steps[0][1] < 0
    return None if bad or np.isnan(out).any() else -out


def fit_margins(blocks: RDD, to: FourierMap, left_out: list[int], penalty: float, max_iter: int) -> dict[int, tuple[np.ndarray, float]]:
    """(weights, intercept) of a hinge-loss model for each fold to leave out. Components are scaled by their deviation
    for the steps, the penalty is on the weights as they are."""
    centre = to(to.mean[None])[0]
    size = len(centre)
    at_fold = np.array(left_out)

    def moments(b: Block) -> np.ndarray:
        z = to(b.x) - centre
        kept = (b.fold[:, None] != at_fold).astype(np.float64)
        return np.concatenate([kept.sum(axis=0)[None], z.T @ kept, (z * z).T @ kept])

    got = _total(blocks, (1 + 2 * size, len(left_out)), moments)
    count, one, two = got[0], got[1:1 + size], got[1 + size:]
    deviation = np.sqrt(np.maximum(two - one ** 2 / count, 0) / np.maximum(count - 1, 1))
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 1e-12)
    mean = centre[:, None] + one / count
    searches = [_descent(size + 1, max_iter) for _ in left_out]
    points, ends = {i: next(s) for i, s in enumerate(searches)}, {}

    def plain(i: int, point: np.ndarray) -> tuple[np.ndarray, float]:
        weights = point[:size] * scale[:, i]
        return weights, float(point[size] - weights @ mean[:, i])

    while points:
        asked = list(points)
        pairs = [plain(i, points[i]) for i in asked]
        weights, shift = np.stack([w for w, _ in pairs], axis=1), np.array([s for _, s in pairs])
        out = at_fold[asked]

        def measure(b: Block, weights=weights, shift=shift, out=out) -> np.ndarray:
            z = to(b.x)
            loss = 1 - b.label[:, None] * (z @ weights + shift)
            held = (loss > 0) & (b.fold[:, None] != out)
            pull = np.where(held, -b.label[:, None], 0.0)
            return np.concatenate([z.T @ pull, pull.sum(axis=0)[None], np.where(held, loss, 0.0).sum(axis=0)[None]])

        sums = _total(blocks, (size + 2, len(asked)), measure)
        for j, i in enumerate(asked):
            pull, bias, loss = sums[:size, j], sums[size, j], sums[size + 1, j]
            slope = np.append(scale[:, i] * (pull - bias * mean[:, i]), bias) / count[i]
            slope[:size] += penalty * scale[:, i] * pairs[j][0]
            try:
                points[i] = searches[i].send((loss / count[i] + penalty / 2 * float(pairs[j][0] @ pairs[j][0]), slope))
            except StopIteration as end:
                ends[left_out[i]] = plain(i, end.value)
                del points[i]
    return ends


def fit_kernel_svm(train: DataFrame, key: str, label: str, features: list[str], c: float = 1.0, gamma: float | None = None,
                   components: int = COMPONENTS, folds: int = 3, seed: int = 42, max_iter: int = 100) -> Model:
    """The fitted model: a function from rows to the probability of label 1. ``gamma`` is 1 / features if not given."""
    rows = train.where(F.col(label).isNotNull() & finite(features))
    fold = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(folds)).cast("int")
    rows = rows.select(dbl(label).alias("label"), fold.alias("fold"), *[dbl(f).alias(f) for f in features])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                     *[F.stddev_pop(f).alias(f"d{i}") for i, f in enumerate(features)]).first()
    if not stats["n"] or stats["ones"] in (0, stats["n"]):  # nothing to part
        share = stats["ones"] / stats["n"] if stats["n"] else math.nan
        return lambda x: np.full(len(x), share)
    at = [np.array([stats[f"{k}{i}"] for i in range(len(features))]) for k in "md"]
    to = FourierMap(*at, components, gamma or 1.0 / len(features), seed)
    sizes = rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each fold and label
    if any(r["label"] not in (0.0, 1.0) for r in sizes):
        raise ValueError("labels are 0 and 1")
    parted = [k for k in range(folds) if len({r["label"] for r in sizes if r["fold"] != k}) == 2]
    blocks = _blocks(rows, features)
    models = fit_margins(blocks, to, [*parted, ALL], 1.0 / (c * stats["n"]), max_iter)
    weights, bias = models[ALL]
    of = {k: models[k] for k in parted} if parted else {k: models[ALL] for k in range(folds)}

    def margins(part: Iterator[Block]) -> Iterator[tuple[float, float]]:
        for b in part:
            for k, (w, shift) in of.items():
                held = b.fold == k
                yield from zip(((b.label[held] + 1) / 2).tolist(), (to(b.x[held]) @ w + shift).tolist(), strict=True)

    scores = written(train.sparkSession.createDataFrame(blocks.mapPartitions(margins), "label double, margin double", verifySchema=False), "margins")
    blocks.unpersist()
    curve = LogisticRegression(maxIter=max_iter).fit(scores.select("label", array_to_vector(F.array("margin")).alias("features")))
    slope, shift = float(curve.coefficients[0]), float(curve.intercept)

    def predict(x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(slope * (to(x) @ weights + bias) + shift)))

    return predict
