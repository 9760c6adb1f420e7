import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import ensembles, explain, train

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).round(3)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double").repartition(3)


def wide(rows, key="id"):
    out = {}
    for r in rows.collect():
        out.setdefault(r[key], {})[r["feature"]] = r
    return out


def exact_shapley(value, n):
    phi = np.zeros(n)
    for j in range(n):
        others = [k for k in range(n) if k != j]
        for size in range(n):
            w = math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n)
            for s in itertools.combinations(others, size):
                phi[j] += w * (value({*s, j}) - value(set(s)))
    return phi


def test_sampled_values_add_up_and_are_exact_for_a_linear_model(table):
    w = [0.5, -1.0, 2.0, 0.0]
    got = wide(explain.sampled_shapley(table, "id", NAMES, explain.linear_model(w, 1.0), table, pairs=2, rows=1000))
    want = wide(train.linear_attributions(table, NAMES, w, "id"))
    for i, per in got.items():
        assert all(abs(per[c]["phi"] - want[i][c]["phi"]) < 1e-9 for c in NAMES)
        assert abs(sum(r["phi"] for r in per.values()) - (per["a"]["score"] - per["a"]["base"])) < 1e-9


def test_all_orders_give_the_exact_values(table):
    model = lambda x: np.tanh(x[:, 0] * x[:, 1] + x[:, 2]) + x[:, 3] ** 2
    x = np.array([[r[c] for c in NAMES] for r in table.orderBy("id").collect()])
    b = x[:7]
    masks, weights = explain.coalition_weights([list(p) for p in itertools.permutations(range(4))], 4)
    phi = explain.coalition_values(model, x, b, masks) @ weights
    for i in (0, 11, 59):
        value = lambda s, i=i: model(np.where(np.isin(np.arange(4), list(s)), x[i], b)).mean()
        assert np.allclose(phi[i], exact_shapley(value, 4))
    half = explain.sampled_shapley(table, "id", NAMES, model, b, pairs=3)
    for per in wide(half).values():
        assert abs(sum(r["phi"] for r in per.values()) - (per["a"]["score"] - per["a"]["base"])) < 1e-9


def test_rows_that_cannot_be_scored_and_empty_tables(spark, table):
    odd = table.limit(2).unionByName(spark.createDataFrame([(100, None, 1.0, 1.0, 1.0), (101, math.nan, 1.0, 1.0, 1.0)], table.schema))
    for got in (explain.sampled_shapley(odd, "id", NAMES, explain.linear_model([1.0] * 4), table, rows=5),
                explain.local_surrogate(odd, "id", NAMES, explain.linear_model([1.0] * 4))):
        per = wide(got)
        assert len(per) == 4 and all(r["phi"] is None for i in (100, 101) for r in per[i].values())
    assert explain.sampled_shapley(odd.limit(0), "id", NAMES, explain.linear_model([1.0] * 4), table).count() == 0
    assert explain.local_surrogate(odd.limit(0), "id", NAMES, explain.linear_model([1.0] * 4)).count() == 0
    lost = wide(explain.sampled_shapley(odd, "id", NAMES, explain.linear_model([1.0] * 4), odd.limit(0)))
    assert all(r["phi"] is None for per in lost.values() for r in per.values())


def test_surrogate_recovers_a_linear_model(table):
    w = [0.5, -1.0, 2.0, 0.0]
    spread = table.agg(*[F.stddev_pop(c).alias(c) for c in NAMES]).first()
    got = wide(explain.local_surrogate(table, "id", NAMES, explain.linear_model(w), ridge=0.0))
    for per in got.values():
        assert all(abs(per[c]["phi"] - wc * spread[c]) < 1e-9 and abs(per[c]["fidelity"] - 1) < 1e-9 for c, wc in zip(NAMES, w, strict=True))


def test_surrogate_solves_the_normal_equations(table):
    model = explain.logistic_model([1.0, -2.0, 0.5, 0.3])
    got = wide(explain.local_surrogate(table, "id", NAMES, model, samples=80, ridge=2.0, seed=5))
    spread = table.agg(*[F.stddev_pop(c).alias(c) for c in NAMES]).first()
    scale = np.array([spread[c] for c in NAMES])
    noise = explain.unit_normals(80, 4, 5)
    k = np.exp(-(noise ** 2).sum(axis=1) / (0.75 * 2) ** 2)
    k /= k.sum()
    design = np.hstack([np.ones((80, 1)), noise])
    penalty = np.diag([0.0, 1, 1, 1, 1]) * 2.0 / 80
    for r in table.collect():
        y = model(np.array([r[c] for c in NAMES]) + noise * scale)
        beta = np.linalg.solve(design.T @ (design * k[:, None]) + penalty, design.T @ (k * y))
        assert np.allclose([got[r["id"]][c]["phi"] for c in NAMES], beta[1:])
    again = wide(explain.local_surrogate(table.repartition(2), "id", NAMES, model, samples=80, ridge=2.0, seed=5))
    assert all(abs(again[i][c]["phi"] - got[i][c]["phi"]) < 1e-12 for i in got for c in NAMES)


def conditional(tree, x, known, at=0):
    """The mean value below a node: known features choose a side, others take both by their rows."""
    j = tree.feature[at]
    if j < 0:
        return tree.value[at]
    sides = [int(tree.left[at]), int(tree.right[at])]
    if j in known:
        return conditional(tree, x, known, sides[0] if x[j] <= tree.threshold[at] else sides[1])
    return sum(tree.cover[s] / tree.cover[at] * conditional(tree, x, known, s) for s in sides)


@pytest.mark.parametrize(("kind", "settings"), [(DecisionTreeClassifier, {"maxDepth": 5}), (RandomForestClassifier, {"numTrees": 4, "maxDepth": 4}),
                                                (GBTClassifier, {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3})])
def test_tree_attributions_agree_with_all_subsets(spark, table, kind, settings):
    estimator = kind(seed=1, **settings)
    data = table.withColumn("label", (F.col("a") * F.col("b") + F.col("c") > 0).cast("double"))
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(data)
    model = estimator.fit(vectors)
    trees = explain.fitted_trees(model, spark)
    got = wide(explain.tree_attributions(table, "id", NAMES, trees))
    scored = model.transform(vectors)
    margin = F.log(F.col("p") / (1 - F.col("p"))) / 2 if isinstance(estimator, GBTClassifier) else F.col("p")
    scores = {r["id"]: r["s"] for r in scored.withColumn("p", vector_to_array("probability")[1]).select("id", margin.alias("s")).collect()}
    for r in table.collect():
        x = np.array([r[c] for c in NAMES])
        value = lambda s, x=x: sum(w * conditional(t, x, s) for w, t in trees)
        per = got[r["id"]]
        assert np.allclose([per[c]["phi"] for c in NAMES], exact_shapley(value, 4))
        assert abs(per["a"]["score"] - scores[r["id"]]) < 1e-6
        assert abs(sum(per[c]["phi"] for c in NAMES) - (per["a"]["score"] - per["a"]["base"])) < 1e-9


def test_the_explainer_fits_the_model(spark, table):
    data = table.withColumn("label", (F.col("a") + F.col("b") > 0).cast("double"))
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(data)
    tree = DecisionTreeClassifier(maxDepth=2, seed=1).fit(vectors)
    line = LogisticRegression(maxIter=5).fit(vectors)
    own = ensembles.boosted_trees(data, "label", NAMES, rounds=1, depth=1)
    for model, want in ((tree, "tree"), (own, "tree"), (line, "linear"), (explain.logistic_model([1.0] * 4), "sampled")):
        got, how = explain.explained(table, "id", NAMES, model, table, rows=5, pairs=1)
        assert how == want and got.count() == 240 and got.columns == ["id", "feature", "phi"]
