import math
import random

import numpy as np
import pytest

from riskframe.operators import ensembles as en
from riskframe.operators import explain


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for n in range(260):
        a, b, c = rng.randrange(12), rng.randrange(9), rng.randrange(5)
        out.append((n, float(a), float(b), float(c) if n % 17 else None, int((a - 6) * (b - 4) + rng.randrange(9) > 3) if n % 29 else None))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(5)


def plain(rows):
    kept = [r for r in rows if r[4] is not None]
    x = np.array([[v if v is not None else -math.inf for v in r[1:4]] for r in kept])
    return x, np.array([r[4] for r in kept])


def edges(x):
    return [sorted(v for v in set(col) if np.isfinite(v) and v < max(col)) for col in x.T]


def all_margins(model, x):
    return model.margin(np.array(x))


def brute_boosting(x, y, rounds, depth, rate, ridge):
    margin, cuts = np.zeros(len(x)), edges(x)

    def grow(at, g, h, left):
        value = -g[at].sum() / (h[at].sum() + ridge)
        best = (0.0, None)
        if left:
            for f in range(x.shape[1]):
                for t in cuts[f]:
                    low = at & (x[:, f] <= t)
                    high = at & ~low
                    if h[low].sum() < 1 or h[high].sum() < 1:
                        continue
                    gain = round((g[low].sum() ** 2 / (h[low].sum() + ridge) + g[high].sum() ** 2 / (h[high].sum() + ridge)
                                  - g[at].sum() ** 2 / (h[at].sum() + ridge)) / 2, 7)
                    if gain > best[0]:
                        best = (gain, (f, t))
        if best[1] is None:
            return np.where(at, value, 0.0)
        f, t = best[1]
        return grow(at & (x[:, f] <= t), g, h, left - 1) + grow(at & (x[:, f] > t), g, h, left - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + rate * grow(np.ones(len(x), bool), p - y, p * (1 - p), depth)
    return margin


def test_boosting_agrees_with_all_splits(frame, rows):
    x, y = plain(rows)
    model = en.boosted_trees(frame, "y", ["a", "b", "c"], rounds=4, depth=3, rate=0.3)
    assert np.allclose(all_margins(model, x), brute_boosting(x, y, 4, 3, 0.3, 1.0), atol=1e-6)
    again = en.boosted_trees(frame.repartition(2), "y", ["a", "b", "c"], rounds=4, depth=3, rate=0.3)
    assert all(np.array_equal(p, q) for (_, s), (_, t) in zip(model.trees, again.trees, strict=True) for p, q in zip(s, t, strict=True))


def brute_adaboost(x, y, rounds):
    w, out, cuts = np.full(len(x), 1 / len(x)), np.zeros(len(x)), edges(x)
    for _ in range(rounds):
        best = (math.inf, None)
        for f in range(x.shape[1]):
            for t in cuts[f]:
                score = 0.0
                for side in (x[:, f] <= t, x[:, f] > t):
                    s = np.array([w[side & (y == k)].sum() for k in (0, 1)])
                    score += s.sum() - (s ** 2).sum() / s.sum()
                if round(score, 11) < best[0]:
                    best = (round(score, 11), (x[:, f] <= t))
        says = np.zeros(len(x), int)
        for side in (best[1], ~best[1]):
            says[side] = int(w[side & (y == 1)].sum() > w[side & (y == 0)].sum())
        error = w[says != y].sum()
        vote = math.log((1 - error) / error)
        w = w * np.exp(vote * (says != y))
        w /= w.sum()
        out += vote * (2 * says - 1)
    return out


def test_adaboost_agrees_with_all_stumps(frame, rows):
    x, y = plain(rows)
    model = en.adaboost(frame, "y", ["a", "b", "c"], rounds=8)
    assert len(model.trees) == 8 and np.allclose(all_margins(model, x), brute_adaboost(x, y, 8), atol=1e-6)


def test_a_faultless_stump_decides_alone(spark):
    df = spark.createDataFrame([(float(n), int(n > 4)) for n in range(10)], "a double, y int")
    model = en.adaboost(df, "y", ["a"], rounds=5)
    assert len(model.trees) == 1
    got = en.scored(df.withColumnRenamed("y", "truth"), "a", model, ["truth"]).collect()
    assert all(r["pred"] == r["truth"] for r in got)


def brute_extra(x, y, t, depth, seed, per_node):
    cuts = edges(x)
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    value, queue, number = np.zeros(len(x)), [(0, np.ones(len(x), bool))], 1
    for _ in range(depth + 1):
        following = []
        for node, at in queue:
            value[at] = y[at].mean()
            if _ == depth or y[at].min() == y[at].max():
                continue
            best = None
            for f in sorted(range(x.shape[1]), key=lambda f: en._draw(seed, t, node, "feature", f))[:per_node]:
                low, high = bins[at, f].min(), bins[at, f].max()
                if low == high:
                    continue
                cut = low + int(en._draw(seed, t, node, "threshold", f) * (high - low))
                sides = at & (bins[:, f] <= cut), at & (bins[:, f] > cut)
                impurity = sum(s.sum() - sum((s & (y == k)).sum() ** 2 for k in (0, 1)) / s.sum() for s in sides)
                if best is None or (impurity, f) < best[:2]:
                    best = (impurity, f, sides)
            if best:
                following += [(number, best[2][0]), (number + 1, best[2][1])]
                number += 2
        queue = following
    return value


def test_extra_trees_agree_with_the_rule(frame, rows):
    x, y = plain(rows)
    model = en.extra_trees(frame, "y", ["a", "b", "c"], trees=5, depth=4, at_once=2)
    want = sum(brute_extra(x, y, t, 4, 42, 2) for t in range(5)) / 5
    assert np.allclose(all_margins(model, x), want)


def test_scores_and_attributions_go_together(frame):
    model = en.boosted_trees(frame, "y", ["a", "b", "c"], rounds=3, depth=2)
    probs = {r["id"]: r["prob"] for r in en.scored(frame, "id", model).collect()}
    whole = frame.where("c IS NOT NULL")
    for r in explain.tree_attributions(whole, "id", ["a", "b", "c"], model.trees).where("feature = 'a'").collect():
        assert abs(1 / (1 + math.exp(-r["score"])) - probs[r["id"]]) < 1e-12


def test_rows_of_one_file_are_binned_by_every_task(frame):
    data = en.binned(frame.coalesce(1), "y", ["a", "b", "c"])
    assert data.rows.rdd.getNumPartitions() == 4 and data.count == frame.where("y IS NOT NULL").count()


def test_no_rows_and_one_class(spark, frame):
    none = frame.where("y IS NULL")
    ones = frame.where("y = 1")
    for fit in (en.boosted_trees, en.adaboost, en.extra_trees):
        model = fit(none, "y", ["a", "b"])
        assert model.trees == [] and en.scored(frame, "id", model).count() == 260
        few = {"trees": 2} if fit is en.extra_trees else {"rounds": 2}
        assert en.scored(ones, "id", fit(ones, "y", ["a", "b"], **few)).where("prob < 0.5").count() == 0
