import math
import random

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector

from riskframe.operators import explain, kernel_svm


def ring(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r, a = (rng.uniform(0, 1), 0) if i % 2 else (rng.uniform(1.3, 2.3), 1)
        t = rng.uniform(0, 2 * math.pi)
        out.append((i, r * math.cos(t), 100 + 10 * r * math.sin(t), a))
    return out


def auc(pairs):
    ones, zeros = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)


def test_a_ring_is_told_apart_and_probabilities_are_calibrated(spark):
    names = ["a", "b"]
    train = spark.createDataFrame(ring(300, 1) + [(900, None, 1.0, 1), (901, 1.0, 1.0, None)], "id long, a double, b double, y int")
    test = spark.createDataFrame(ring(300, 2) + [(900, None, 1.0, 1)], "id long, a double, b double, y int")
    fit = {"gamma": 1.0, "folds": 2, "max_iter": 20}
    model = kernel_svm.fit_kernel_svm(train, "id", "y", names, **fit)
    got = explain.scored(test, "id", names, model, ["y", "a", "b"]).collect()
    assert len(got) == 301 and next(r for r in got if r["id"] == 900)["prob"] is None
    pairs = [(r["prob"], r["y"]) for r in got if r["prob"] is not None]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train.dropna().withColumnRenamed("y", "label"))
    line = LogisticRegression().fit(vectors)
    plain = [(float(line.coefficients.dot([r["a"], r["b"]])), r["y"]) for r in got if r["prob"] is not None]
    assert auc(pairs) > 0.97 and auc(plain) < 0.7
    assert abs(np.mean([p for p, _ in pairs]) - np.mean([y for _, y in pairs])) < 0.06


def test_inner_products_approach_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    z = kernel_svm.FourierMap(np.zeros(3), np.ones(3), 20_000, 0.4, 7)(x)
    kernel = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.7, 1)], "id long, a double, y int")
    assert kernel_svm.fit_kernel_svm(df, "id", "y", ["a"])(np.zeros((2, 1))).tolist() == [1.0, 1.0]
    assert np.isnan(kernel_svm.fit_kernel_svm(df.limit(0), "id", "y", ["a"])(np.zeros((2, 1)))).all()


def test_models_side_by_side_are_those_of_linear_svc(spark):
    rows = [(float(y), i % 3, a, b) for i, a, b, y in ring(240, 3)]
    x = np.array([r[2:] for r in rows])
    to = kernel_svm.FourierMap(x.mean(axis=0), x.std(axis=0), 20, 0.7, 5)
    blocks = kernel_svm._blocks(spark.createDataFrame(rows, "label double, fold int, a double, b double"), ["a", "b"])
    got = kernel_svm.fit_margins(blocks, to, [0, kernel_svm.ALL], 0.01, 8)
    mapped = spark.createDataFrame([(r[0], r[1], z.tolist()) for r, z in zip(rows, to(x), strict=True)], "label double, fold int, z array<double>")
    for fold, (weights, intercept) in got.items():
        want = LinearSVC(regParam=0.01, maxIter=8, standardization=False).fit(
            mapped.where(f"fold != {fold}").select("label", array_to_vector("z").alias("features")))
        assert np.allclose(weights, want.coefficients.toArray(), atol=1e-9) and abs(intercept - want.intercept) < 1e-9


def test_all_folds_share_a_pass(spark):
    df = spark.createDataFrame(ring(300, 4), "id long, a double, b double, y int")
    spark.sparkContext.setJobGroup("kernel", "kernel")
    kernel_svm.fit_kernel_svm(df, "id", "y", ["a", "b"], gamma=1.0, max_iter=15)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("kernel"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 90  # four fits by themselves take more than 120


def test_cosines():
    x = np.linspace(-50, 50, 100_001)
    assert np.abs(kernel_svm.cosine(x) - np.cos(x)).max() < 1e-14
