"""Tree ensembles grown from histograms: second-order boosting (M-16), AdaBoost over
stumps (M-14) and extra trees (M-15).

Features are cut into at most ``MAX_BINS`` bins once, and the training rows
are written as one byte a feature. A tree grows a level at a time: every task
drops its rows down the trees so far, adds up what the level needs for each
(node, feature, bin), and one grouped sum over these partial tables reaches
the driver, where the splits are chosen. Its size is that of the level, not of
the data. Rows never move and nothing is written a round: a row's margin,
weight or node follows from its bins and the trees so far.

Sums are taken in integers (fixed point), so trees do not depend on how rows
are spread over tasks. Of equally good splits the one of the first feature,
then of the lowest threshold, is taken. A row goes left where its value is at
most the threshold; a null or NaN goes left. Rows without a label do not
train. Labels are 0 and 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import dbl
from riskframe.operators import explain
from riskframe.operators.explain import Tree
from riskframe.session import dealt, written

MAX_BINS = 64
TASK_ROWS = 1 << 15
FIXED_POINT = 1 << 32


class Ensemble(NamedTuple):
    features: list[str]
    trees: list[tuple[float, Tree]]                 # weight and tree
    link: Callable[[np.ndarray], np.ndarray]        # from the weighted sum to a probability of label 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, tree in self.trees:
            total += weight * tree.value[reached(tree, x, tree.threshold)]
        return total


class Binned(NamedTuple):
    rows: DataFrame             # label, bins (a byte a feature)
    edges: list[np.ndarray]     # the thresholds of each feature, ascending
    count: int


def reached(tree: Tree, x: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The leaf of each row. ``x`` and ``threshold`` are both values or both bins."""
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(tree.feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        left = x[inner, tree.feature[node]] <= threshold[node]
        at[inner] = np.where(left, tree.left[node], tree.right[node])


def values_of(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in features], axis=1)
    x[np.isnan(x)] = -np.inf
    return x


def binned(train: DataFrame, label: str, features: list[str], max_bins: int = MAX_BINS, accuracy: int = 10_000) -> Binned:
    """The labelled rows as bins between (approximate) quantiles of each feature; at most ``max_bins`` numbers a feature reach the driver."""
    if not 2 <= max_bins <= 256:
        raise ValueError("a bin is one byte")
    rows = train.where(F.col(label).isNotNull())
    cuts = [i / max_bins for i in range(1, max_bins)]
    finite = {c: F.when(~F.isnan(dbl(c)), dbl(c)) for c in features}
    got = rows.agg(*[F.percentile_approx(v, cuts, accuracy).alias(c) for c, v in finite.items()],
                   *[F.max(v).alias(f"_max_{n}") for n, v in enumerate(finite.values())]).first()
    # A threshold at the largest value would part nothing.
    edges = [np.array(sorted({x for x in got[c] or [] if x < got[f"_max_{n}"]}), np.float64) for n, c in enumerate(features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = values_of(b, features)
            bins = np.stack([np.searchsorted(e, x[:, n], "left") for n, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("_label"), pa.array([r.tobytes() for r in bins], pa.binary())], names=["label", "bins"])

    # Dealt, as every level passes over them: some bytes a row are few files, and so few tasks, however many rows there are.
    table = written(dealt(rows.select(F.col(label).cast("int").alias("_label"), *[dbl(c).alias(c) for c in features]), TASK_ROWS)
                    .mapInArrow(run, "label int, bins binary"), "bins")
    return Binned(table, edges, table.count())


def summed(data: Binned, shape: tuple[int, ...], measure: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """An integer table of ``shape``, added up over all rows. ``measure(bins, label)`` yields (flat places, integers)."""
    width, size = len(data.edges), math.prod(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            if len(b):
                bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(len(b), width)
                for place, amount in measure(bins, b.column("label").to_numpy()):
                    np.add.at(total, place, amount)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["place", "amount"])

    parts = data.rows.mapInArrow(run, "place long, amount long")
    out = np.zeros(size)
    for r in parts.groupBy("place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect():  # at most ``size`` rows
        out[r["place"]] = float(r["amount"])
    return out.reshape(shape)


class Grower:
    """A tree in the making: nodes as lists, with thresholds as bins too."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right = [-1], [0], [-1], [-1]
        self.value, self.cover = [0.0], [0.0]

    def split(self, node: int, feature: int, at_bin: int) -> tuple[int, int]:
        for column, start in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.cover, 0.0)):
            column += [start, start]
        pair = len(self.feature) - 2, len(self.feature) - 1
        self.feature[node], self.bin[node], (self.left[node], self.right[node]) = feature, at_bin, pair
        return pair

    def tree(self, edges: list[np.ndarray]) -> Tree:
        threshold = [edges[f][b] if f >= 0 else 0.0 for f, b in zip(self.feature, self.bin, strict=True)]
        return Tree(np.array(self.feature), np.array(threshold), np.array(self.left), np.array(self.right),
                    np.array(self.value, np.float64), np.array(self.cover, np.float64))

    def bins(self) -> tuple[Tree, np.ndarray]:
        return self.tree([np.arange(256.0)] * 256), np.array(self.bin)


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


# ---------------------------------------------------------------- second-order boosting

def boosted_trees(train: DataFrame, label: str, features: list[str], rounds: int = 100, depth: int = 6, rate: float = 0.3,
                  ridge: float = 1.0, least_gain: float = 0.0, least_hessian: float = 1.0, max_bins: int = MAX_BINS) -> Ensemble:
    """Logistic boosting with second-order gains: a split gains
    ``(GL^2 / (HL + ridge) + GR^2 / (HR + ridge) - G^2 / (H + ridge)) / 2``, a leaf
    is ``-G / (H + ridge)``, times ``rate``. One aggregate a level."""
    data = binned(train, label, features, max_bins)
    done: list[tuple[Tree, np.ndarray]] = []
    trees = []
    for _ in range(rounds if data.count else 0):
        grower, open_nodes = Grower(), [0]
        for level in range(depth + 1):
            now, places = grower.bins(), {n: i for i, n in enumerate(open_nodes)}

            def measure(bins, y, now=now, places=places):
                margin = np.zeros(len(bins))
                for tree, cuts in done:
                    margin += rate * tree.value[reached(tree, bins, cuts)]
                p = _sigmoid(margin)
                at = reached(now[0], bins, now[1])
                slot = np.array([places.get(n, -1) for n in range(len(now[0].feature))])[at]
                rows = np.flatnonzero(slot >= 0)
                parts = [np.rint((p - y)[rows] * FIXED_POINT), np.rint((p * (1 - p))[rows] * FIXED_POINT), np.ones(len(rows))]
                for f in range(bins.shape[1]):
                    cell = (slot[rows] * bins.shape[1] + f) * max_bins + bins[rows, f]
                    for k, part in enumerate(parts):
                        yield cell * 3 + k, part.astype(np.int64)

            table = summed(data, (len(open_nodes), len(features), max_bins, 3), measure)
            table[..., :2] /= FIXED_POINT
            following = []
            for i, node in enumerate(open_nodes):
                g, h, n = table[i, 0].sum(axis=0)
                grower.value[node], grower.cover[node] = -g / (h + ridge), n
                if level == depth:
                    continue
                before = np.cumsum(table[i], axis=1)[:, :-1]  # feature, bin, what goes left
                gl, hl = before[..., 0], before[..., 1]
                gain = (gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)) / 2
                usable = (hl >= least_hessian) & (h - hl >= least_hessian) & (before[..., 2] > 0) & (before[..., 2] < n)
                gain = np.where(usable, np.round(gain, 9), -np.inf)
                best = int(gain.argmax())
                if gain.flat[best] > least_gain:
                    following += grower.split(node, *divmod(best, max_bins - 1))
            open_nodes = following
            if not open_nodes:
                break
        done.append(grower.bins())
        trees.append((rate, grower.tree(data.edges)))
    return Ensemble(features, trees, _sigmoid)


# ---------------------------------------------------------------- AdaBoost over stumps

def adaboost(train: DataFrame, label: str, features: list[str], rounds: int = 100, max_bins: int = MAX_BINS) -> Ensemble:
    """Two-class SAMME with stumps: each round takes the stump of least weighted Gini
    impurity, its vote is ``log((1 - error) / error)``, and the rows it gets wrong gain
    that much log-weight. It ends early with a faultless stump (which then decides
    alone if it is the first) or one no better than chance. One aggregate a round."""
    data = binned(train, label, features, max_bins)
    stumps: list[tuple[int, int, int, int, float]] = []  # feature, bin, label left, label right, vote
    trees: list[tuple[float, Tree]] = []
    log_total = math.log(data.count) if data.count else 0.0
    for _ in range(rounds if data.count else 0):

        def measure(bins, y, total=log_total):
            log_weight = np.zeros(len(bins))
            for f, b, left, right, vote in stumps:
                log_weight += vote * (np.where(bins[:, f] <= b, left, right) != y)
            w = np.rint(np.exp(log_weight - total) * 2.0 ** 52).astype(np.int64)
            for f in range(bins.shape[1]):
                cell = (f * max_bins + bins[:, f].astype(np.int64)) * 4 + 2 * y
                yield cell, w
                yield cell + 1, np.ones(len(bins), np.int64)

        table = summed(data, (len(features), max_bins, 2, 2), measure)  # feature, bin, label, (weight, rows)
        weight, rows = table[..., 0] / table[0, ..., 0].sum(), table[..., 1]
        left = np.cumsum(weight, axis=1)[:, :-1]
        right = weight.sum(axis=1, keepdims=True) - left
        n_left = np.cumsum(rows.sum(axis=2), axis=1)[:, :-1]

        def impurity(side: np.ndarray) -> np.ndarray:
            total = side.sum(axis=2)
            return total - (side ** 2).sum(axis=2) / np.maximum(total, 1e-300)

        score = np.where((n_left > 0) & (n_left < data.count), np.round(impurity(left) + impurity(np.maximum(right, 0)), 12), np.inf)
        best = int(score.argmin())
        if not np.isfinite(score.flat[best]):
            break
        f, b = divmod(best, max_bins - 1)
        sides = left[f, b], np.maximum(right[f, b], 0)
        says = [int(s[1] > s[0]) for s in sides]
        error = float(sides[0][1 - says[0]] + sides[1][1 - says[1]])
        grower = Grower()
        pair = grower.split(0, f, b)
        grower.cover[0] = float(data.count)
        for node, vote, n in zip(pair, says, (n_left[f, b], data.count - n_left[f, b]), strict=True):
            grower.value[node], grower.cover[node] = 2.0 * vote - 1.0, float(n)
        if error <= 1e-12:
            if not trees:
                trees.append((1.0, grower.tree(data.edges)))
            break
        if error >= 0.5:
            break
        vote = math.log((1 - error) / error)
        stumps.append((f, b, *says, vote))
        trees.append((vote, grower.tree(data.edges)))
        log_total += math.log(1 - error + error * math.exp(vote))
    votes = sum(w for w, _ in trees) or 1.0
    return Ensemble(features, trees, lambda margin: _sigmoid(2 * margin / votes))


# ---------------------------------------------------------------- extra trees

def _draw(*parts: object) -> float:
    """A number from 0 to 1 (exclusive) that belongs to the parts."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16 ** 13


def extra_trees(train: DataFrame, label: str, features: list[str], trees: int = 100, depth: int = 8, seed: int = 42,
                per_node: int | None = None, at_once: int = 20, max_bins: int = MAX_BINS) -> Ensemble:
    """Extremely randomised trees on all rows: a node looks at ``per_node`` features
    (the root of their number) that a hash draws, each with one threshold drawn
    between the node's lowest and highest bin, and takes the one of least Gini
    impurity. ``at_once`` trees grow side by side, one aggregate a level."""
    data = binned(train, label, features, max_bins)
    per_node = per_node or max(1, round(math.sqrt(len(features))))
    out: list[tuple[float, Tree]] = []
    for first in range(0, trees if data.count else 0, at_once):
        growers = {t: Grower() for t in range(first, min(first + at_once, trees))}
        open_nodes = [(t, 0) for t in growers]
        for level in range(depth + 1):
            looks = [sorted(range(len(features)), key=lambda f, t=t, n=n: _draw(seed, t, n, "feature", f))[:per_node] for t, n in open_nodes]
            now = {t: g.bins() for t, g in growers.items()}
            slots = {t: {n: i for i, (u, n) in enumerate(open_nodes) if u == t} for t in growers}

            def measure(bins, y, now=now, slots=slots, looks=looks):
                seen = np.array(looks, np.int64)
                for t, (tree, cuts) in now.items():
                    slot = np.array([slots[t].get(n, -1) for n in range(len(tree.feature))])[reached(tree, bins, cuts)]
                    rows = np.flatnonzero(slot >= 0)
                    for k in range(per_node):
                        b = bins[rows, seen[slot[rows], k]]
                        cell = ((slot[rows] * per_node + k) * max_bins + b) * 2 + y[rows]
                        place, amount = np.unique(cell, return_counts=True)
                        yield place, amount

            table = summed(data, (len(open_nodes), per_node, max_bins, 2), measure)
            following = []
            for i, (t, node) in enumerate(open_nodes):
                n = table[i, 0].sum(axis=0)
                growers[t].value[node], growers[t].cover[node] = float(n[1] / max(n.sum(), 1)), float(n.sum())
                if level == depth or min(n) == 0:
                    continue
                best = None
                for k, f in enumerate(looks[i]):
                    held = np.flatnonzero(table[i, k].sum(axis=1))
                    if len(held) < 2:
                        continue
                    low, high = int(held[0]), int(held[-1])
                    cut = low + int(_draw(seed, t, node, "threshold", f) * (high - low))
                    left = table[i, k, :cut + 1].sum(axis=0)
                    right = n - left
                    impurity = sum(s.sum() - (s ** 2).sum() / s.sum() for s in (left, right))
                    if best is None or (impurity, f) < best[:2]:
                        best = (impurity, f, cut)
                if best:
                    following += [(t, child) for child in growers[t].split(node, best[1], best[2])]
            open_nodes = following
            if not open_nodes:
                break
        out += [(1.0 / trees, g.tree(data.edges)) for g in growers.values()]
    return Ensemble(features, out, lambda margin: margin)


def scored(df: DataFrame, key: str, model: Ensemble, keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, prob, pred): the ensemble's probability of label 1 and whether it is above a half. No shuffle."""

    def predict(x: np.ndarray) -> np.ndarray:
        return model.link(model.margin(np.where(np.isnan(x), -np.inf, x)))

    return explain.scored(df, key, model.features, predict, keep)
