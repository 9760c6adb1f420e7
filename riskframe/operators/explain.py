"""Explanations of any scoring model: sampled Shapley values (X-3), path-dependent tree
attributions (X-1) and local surrogates (X-6).

A model is a function from a block of rows (a float64 matrix) to scores. It
travels with the tasks, and rows are explained where they lie, in Arrow
blocks of bounded size: no shuffle, and nothing grows with the table but its
own result. Draws come from hashes or a seed, so a run can be repeated. A row
with a null or non-finite feature has null contributions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import dbl

Model = Callable[[np.ndarray], np.ndarray]
BLOCK_VALUES = 1 << 20


def logistic_model(weights: list[float], bias: float = 0.0) -> Model:
    w = np.array(weights, np.float64)
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w + bias)))


def linear_model(weights: list[float], bias: float = 0.0) -> Model:
    w = np.array(weights, np.float64)
    return lambda x: x @ w + bias


def finite(features: list[str]) -> Column:
    """Whether every feature is a finite number."""
    inf = float("inf")
    cond = F.lit(True)
    for c in features:
        cond = cond & F.coalesce((dbl(c) < inf) & (dbl(c) > -inf), F.lit(False))
    return cond


def scored(df: DataFrame, key: str, features: list[str], model: Model, keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, prob, pred): the model's score of every row and whether it is above a half. No shuffle."""
    keep = [key, *(keep or [])]
    rows = df.select(*keep, *[dbl(c).alias(f"_x{n}") for n, c in enumerate(features)])
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f"_x{n}").to_numpy(zero_copy_only=False).astype(np.float64) for n in range(len(features))], axis=1)
            p = model(x)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p, from_pandas=True),
                                              pa.array((p > 0.5).astype(np.int32), mask=np.isnan(p))], names=[*keep, "prob", "pred"])

    return rows.mapInArrow(run, f"{kinds}, prob double, pred int")


# ---------------------------------------------------------------- sampled Shapley values

def feature_orders(features: list[str], pairs: int, seed: int) -> list[list[int]]:
    """``pairs`` orders of the features by a hash, each followed by its reverse (antithetic pairs)."""
    out = []
    for p in range(pairs):
        order = sorted(range(len(features)), key=lambda j: hashlib.sha256(f"{p}|{features[j]}|{seed}".encode()).hexdigest())
        out += [order, order[::-1]]
    return out


def coalition_weights(orders: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(coalitions, weights): the different coalitions that the orders run through as
    masks, and how much each one's value counts for each feature."""
    masks: dict[tuple, int] = {}
    entries = []
    for order in orders:
        present = [False] * n
        at = masks.setdefault(tuple(present), len(masks))
        for j in order:
            present[j] = True
            after = masks.setdefault(tuple(present), len(masks))
            entries += [(after, j, 1.0), (at, j, -1.0)]
            at = after
    weights = np.zeros((len(masks), n))
    for at, j, sign in entries:
        weights[at, j] += sign / len(orders)
    return np.array(list(masks), bool).reshape(len(masks), n), weights


def coalition_values(model: Model, x: np.ndarray, background: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For every row and coalition the mean score over the background rows, with the
    coalition's features taken from the row."""
    out = np.empty((len(x), len(masks)))
    rows = max(1, BLOCK_VALUES // background.size)
    for begin in range(0, len(x), rows):
        part = x[begin:begin + rows]
        for m, mask in enumerate(masks):
            mixed = np.where(mask, part[:, None, :], background[None, :, :])
            out[begin:begin + rows, m] = model(mixed.reshape(-1, x.shape[1])).reshape(len(part), -1).mean(axis=1)
    return out


def background_rows(df: DataFrame, key: str, features: list[str], rows: int, seed: int) -> np.ndarray:
    """The ``rows`` rows first by a hash of their key (then by the features): a bounded, repeatable background."""
    order = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"), 256)
    got = df.select(order.alias("h"), *[dbl(c).alias(c) for c in features]).where(finite(features)).orderBy("h", *features).limit(rows)
    return np.array([list(r)[1:] for r in got.collect()], np.float64).reshape(-1, len(features))


def _contributions(df: DataFrame, key: str, features: list[str], extra: list[str],
                   explain: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """(key, feature, phi, extra...): ``explain`` gives, for a block of rows, a matrix of
    contributions and a vector for each extra column."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in features], axis=1)
            good = np.isfinite(x).all(axis=1)
            phi = np.full(x.shape, np.nan)
            more = [np.full(len(x), np.nan) for _ in extra]
            if good.any():
                got, *vectors = explain(x[good])
                phi[good] = got
                for column, values in zip(more, vectors, strict=True):
                    column[good] = values
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features)),
                                             pa.array(phi.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([b.column(key), lists, *[pa.array(m, from_pandas=True) for m in more]],
                                             names=[key, "phi", *extra])

    rows = df.select(key, *[dbl(c).alias(c) for c in features if c != key])
    got = rows.mapInArrow(run, ", ".join([f"`{key}` {kind}", "phi array<double>", *[f"{c} double" for c in extra]]))
    names = F.array(*[F.lit(c) for c in features])
    return got.select(key, F.posexplode("phi").alias("n", "phi"), *extra).select(
        key, F.get(names, F.col("n")).alias("feature"), "phi", *extra)


def sampled_shapley(df: DataFrame, key: str, features: list[str], model: Model, background: np.ndarray | DataFrame,
                    pairs: int = 5, rows: int = 50, seed: int = 42) -> DataFrame:
    """(key, feature, phi, base, score): Shapley values of ``model`` by ``pairs`` antithetic
    pairs of feature orders against a background of at most ``rows`` rows.

    The orders are shared by all rows, and each coalition they run through is
    evaluated once. A row's contributions add up to ``score - base``, with base
    the background's mean score; for a linear model they are exact.
    """
    b = background_rows(background, key, features, rows, seed) if isinstance(background, DataFrame) else background
    masks, weights = coalition_weights(feature_orders(features, pairs, seed), len(features))
    base = float(model(b).mean()) if len(b) else math.nan

    def explain(x: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(b):
            return np.full(x.shape, np.nan), np.full(len(x), np.nan), model(x)
        return coalition_values(model, x, b, masks) @ weights, np.full(len(x), base), model(x)

    return _contributions(df, key, features, ["base", "score"], explain)


# ---------------------------------------------------------------- local surrogates

def unit_normals(samples: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((samples, n))


def surrogate_solver(noise: np.ndarray, ridge: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, solver): each draw's kernel weight, and the matrix that takes a row's
    centred scores to its ridge coefficients (intercept not penalised).

    The draws lie around every row in the same way, so the weighted Gram matrix
    is the same for all rows and is summed and inverted once.
    """
    w = np.exp(-(noise ** 2).sum(axis=1) / width ** 2)
    w = w / w.sum()
    centred = noise - w @ noise
    gram = centred.T @ (centred * w[:, None])
    return w, np.linalg.solve(gram + ridge * np.eye(noise.shape[1]) / len(noise), (centred * w[:, None]).T)


def local_surrogate(df: DataFrame, key: str, features: list[str], model: Model, samples: int = 500, ridge: float = 1.0,
                    width: float | None = None, seed: int = 42) -> DataFrame:
    """(key, feature, phi, fidelity, score): around every row a weighted ridge regression of
    ``model``'s scores at ``samples`` normal draws, one standard deviation of each feature wide.

    ``phi`` is the coefficient for a step of one standard deviation; a draw's
    weight is ``exp(-distance^2 / width^2)`` in those units, with a width of 0.75
    times the root of the number of features; ``fidelity`` is the weighted share
    of the scores' variance that the regression explains (1 where there is none).
    A feature that does not vary has the coefficient 0.
    """
    spread = df.where(finite(features)).agg(*[F.stddev_pop(dbl(c)).alias(c) for c in features]).first()
    scale = np.array([spread[c] or 0.0 for c in features])
    noise = unit_normals(samples, len(features), seed) * (scale > 0)
    weights, solver = surrogate_solver(noise, ridge, width or 0.75 * math.sqrt(len(features)))

    def explain(x: np.ndarray) -> tuple[np.ndarray, ...]:
        phi, fidelity = np.empty(x.shape), np.empty(len(x))
        rows = max(1, BLOCK_VALUES // noise.size)
        for begin in range(0, len(x), rows):
            part = x[begin:begin + rows]
            y = model((part[:, None, :] + noise * scale).reshape(-1, x.shape[1])).reshape(len(part), samples)
            y = y - (y @ weights)[:, None]
            own = y @ solver.T
            left = y - own @ (noise - weights @ noise).T
            total = (y ** 2) @ weights
            phi[begin:begin + rows] = own
            with np.errstate(divide="ignore", invalid="ignore"):
                fidelity[begin:begin + rows] = np.where(total > 1e-24, 1 - (left ** 2 @ weights) / total, 1.0)
        return phi, fidelity, model(x)

    return _contributions(df, key, features, ["fidelity", "score"], explain)


# ---------------------------------------------------------------- tree attributions

class Tree(NamedTuple):
    """A tree as node arrays; a leaf has the feature -1."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray


class Leaf(NamedTuple):
    value: float
    features: list[int]           # the different features on its path
    low: np.ndarray               # a row reaches the leaf if every one is above low and at most high
    high: np.ndarray
    share: np.ndarray             # the share of the training rows that goes on where the feature is unknown


def leaves(tree: Tree) -> list[Leaf]:
    out, stack = [], [(0, {})]
    while stack:
        at, path = stack.pop()
        if tree.feature[at] < 0:
            f = sorted(path)
            out.append(Leaf(float(tree.value[at]), f, *(np.array([path[j][k] for j in f]) for k in range(3))))
            continue
        j, t = int(tree.feature[at]), float(tree.threshold[at])
        low, high, share = path.get(j, (-math.inf, math.inf, 1.0))
        for child, a, b in ((int(tree.left[at]), low, min(high, t)), (int(tree.right[at]), max(low, t), high)):
            part = tree.cover[child] / tree.cover[at] if tree.cover[at] else 0.0
            stack.append((child, path | {j: (a, b, share * part)}))
    return out


def tree_contributions(all_leaves: list[tuple[float, Leaf]], x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(contributions, base, scores) of weighted leaves for a block of rows.

    With some features known, a leaf's part of the score is its value times,
    for each feature on its path, 0 or 1 where it is known and the share where
    it is not. The Shapley values of that product come from the coefficients of
    a polynomial with one factor a feature.
    """
    phi, base, score = np.zeros(x.shape), 0.0, np.zeros(len(x))
    for weight, leaf in all_leaves:
        m = len(leaf.features)
        held = x[:, leaf.features]
        go = ((held > leaf.low) & (held <= leaf.high)).astype(np.float64)
        base += weight * leaf.value * float(np.prod(leaf.share))
        score += weight * leaf.value * go.prod(axis=1)
        count = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
        for u in range(m):
            poly = [np.ones(len(x))]  # by the number of known features among the others
            for v in range(m):
                if v != u:
                    known, unknown = go[:, v], leaf.share[v]
                    poly = [(poly[s] * unknown if s < len(poly) else 0) + (poly[s - 1] * known if s else 0) for s in range(len(poly) + 1)]
            mean = sum(c * p for c, p in zip(count, poly, strict=True))
            phi[:, leaf.features[u]] += weight * leaf.value * (go[:, u] - leaf.share[u]) * mean
    return phi, base, score


def tree_attributions(df: DataFrame, key: str, features: list[str], trees: list[tuple[float, Tree]]) -> DataFrame:
    """(key, feature, phi, base, score): path-dependent Shapley values of a weighted sum of
    trees. They add up to ``score - base``; base is the trees' mean over their training rows."""
    flat = [(w, leaf) for w, tree in trees for leaf in leaves(tree)]

    def explain(x: np.ndarray) -> tuple[np.ndarray, ...]:
        phi, base, score = tree_contributions(flat, x)
        return phi, np.full(len(x), base), score

    return _contributions(df, key, features, ["base", "score"], explain)


def fitted_trees(model, spark, positive: int = 1) -> list[tuple[float, Tree]]:
    """The node arrays of a fitted tree, forest or boosted model of ``pyspark.ml``, through
    its saved form in the shared folder. Forest and tree values are the share of
    class ``positive``; a boosted model's are on the scale of its margin."""
    import uuid

    from riskframe.session import checkpoint_path
    path = checkpoint_path(spark, f"model-{uuid.uuid4().hex}")
    model.write().save(path)
    boosted = hasattr(model, "treeWeights") and "GBT" in type(model).__name__
    rows = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in rows.columns
    if single:
        rows = rows.select(F.lit(0).alias("treeID"), F.struct(*rows.columns).alias("nodeData"))
    by_tree: dict[int, list] = {}
    for r in rows.select("treeID", "nodeData").collect():  # as large as the model
        by_tree.setdefault(r["treeID"], []).append(r["nodeData"])
    weights = [1.0] if single else list(model.treeWeights)
    out = []
    for n in sorted(by_tree):
        nodes = sorted(by_tree[n], key=lambda r: r["id"])
        place = {r["id"]: i for i, r in enumerate(nodes)}
        inner = [r["leftChild"] >= 0 for r in nodes]

        def value(r) -> float:
            stats = list(r["impurityStats"])
            return float(r["prediction"]) if boosted else stats[positive] / max(sum(stats), 1e-300)

        tree = Tree(np.array([r["split"]["featureIndex"] if i else -1 for r, i in zip(nodes, inner, strict=True)]),
                    np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(nodes, inner, strict=True)]),
                    np.array([place.get(r["leftChild"], -1) for r in nodes]), np.array([place.get(r["rightChild"], -1) for r in nodes]),
                    np.array([value(r) for r in nodes]), np.array([float(r["rawCount"]) for r in nodes]))
        out.append((weights[n] if boosted or single else 1.0 / len(by_tree), tree))
    return out


# ---------------------------------------------------------------- choice of the explainer

def explainer_of(model) -> str:
    """``tree``, ``linear`` or ``sampled``: how contributions of a model are best found."""
    kind = type(model).__name__.lower()
    if any(part in kind for part in ("tree", "forest", "gbt", "boost")) or hasattr(model, "trees"):
        return "tree"
    return "linear" if hasattr(model, "coefficients") else "sampled"


def explained(df: DataFrame, key: str, features: list[str], model, background: DataFrame, rows: int = 50, pairs: int = 5,
              seed: int = 42) -> tuple[DataFrame, str]:
    """((key, feature, phi), explainer) of a fitted ``pyspark.ml`` classifier, an ``Ensemble`` or any
    function of rows: exact for trees (path-dependent) and linear models (against the
    background's means, on the margin), sampled Shapley values for the rest."""
    from riskframe.operators.train import linear_attributions
    how = explainer_of(model)
    if how == "tree":
        trees = fitted_trees(model, df.sparkSession) if hasattr(model, "write") else model.trees
        got = tree_attributions(df, key, features, trees)
    elif how == "linear":
        got = linear_attributions(df, features, model.coefficients.toArray().tolist(), key)
    else:
        got = sampled_shapley(df, key, features, model, background, pairs, rows, seed)
    return got.select(key, "feature", "phi"), how
