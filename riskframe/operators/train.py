"""Model training slice (M-1, M-6..M-10, M-13, X-2).

* Stratified split: exact per-class test share by a deterministic hash
  order, ranked with the two-level cumulative counts (no per-class window).
* Benchmark: MLlib pipelines fitted on the train split and scored on the
  untouched test split into a predictions table, which the metrics
  operators then evaluate.
* Linear attributions: phi_j = w_j (x_j - mean_j) on the log-odds scale.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import dbl, join_keys
from riskframe.operators.ranks import cumulative_before
from riskframe.session import written


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly round(test_share x class size) rows per class,
    chosen by the order of sha2(key || seed) (deterministic, re-runnable). Rows
    without a label are a class of their own; rows without a key come first."""
    h = F.conv(F.substring(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256), 1, 15), 16, 10)
    d = df.withColumn("_h", h.cast("long"))
    counts = d.groupBy(F.col(label).alias("_cls"), F.col("_h")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulative_before(counts, ["_cls"], "_h", "_n", "_rank0")
    sizes = counts.groupBy("_cls").agg(F.sum("_n").alias("_size"))
    cut = join_keys(ranked, sizes, ["_cls"]).select(
        "_cls", "_h", (F.col("_rank0") < F.round(F.col("_size") * test_share)).alias("is_test"))
    return join_keys(d, cut.withColumnRenamed("_cls", label), [label, "_h"]).drop("_h")


def _models(rows: int, seed: int = 42) -> list[tuple[str, object]]:
    """The benchmark's models with its stated settings: L2 logistic regression
    with C = 1 (Spark's penalty is per row), 1000 iterations; a tree of depth
    8; 100 trees grown to Spark's deepest; 100 boosting rounds of depth 3."""
    return [
        ("LogisticRegression", LogisticRegression(maxIter=1000, regParam=1.0 / max(rows, 1), elasticNetParam=0.0,
                                                  standardization=False)),
        ("DecisionTree", DecisionTreeClassifier(maxDepth=8, seed=seed)),
        ("RandomForest", RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed)),
        ("GaussianNB", NaiveBayes(modelType="gaussian")),
        ("GradientBoosting", GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed)),
    ]


def benchmark(split: DataFrame, label: str, features: list[str], key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Fit each model on the train rows, score the test rows.

    Returns (predictions(model, pos, key, label, prob, pred), status(model,
    pos, status, error)). A model that fails to fit has a status row with
    its error; the others continue.
    """
    # The models read the rows again and again: written once, so the split is not made anew each time.
    data = written(split.select(key, dbl(label).alias("label"), "is_test", *[dbl(c).alias(c) for c in features]), "split")
    train = data.where(~F.col("is_test"))
    test = data.where(F.col("is_test"))
    spark = split.sparkSession
    out = spark.createDataFrame([], test.select(F.lit("").alias("model"), F.lit(0).alias("pos"), key, F.lit(0).alias("label"),
                                                F.lit(0.0).alias("prob"), F.lit(0).alias("pred")).schema)
    status = []
    for pos, (name, est) in enumerate(_models(train.count(), seed), start=1):
        try:
            model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), est]).fit(train)
        except Exception as e:  # noqa: BLE001 - reported as a row; the other models continue
            status.append((name, pos, "FAILED", str(e)[:500]))
            continue
        status.append((name, pos, "FITTED", None))
        p = (model.transform(test)
             .select(F.lit(name).alias("model"), F.lit(pos).alias("pos"), key, F.col("label").cast("int").alias("label"),
                     vector_to_array("probability")[1].alias("prob"), F.col("prediction").cast("int").alias("pred")))
        out = out.unionByName(p)
    return out, spark.createDataFrame(status, "model string, pos int, status string, error string")


def linear_attributions(df: DataFrame, features: list[str], weights: list[float], key: str) -> DataFrame:
    """Long (key, feature, phi) with phi = w_j (x_j - mean_j); means are one broadcast row."""
    means = df.agg(*[F.avg(dbl(c)).alias(f"_m_{c}") for c in features])
    j = df.select(key, *features).join(F.broadcast(means), how="cross")
    items = [F.struct(F.lit(c).alias("feature"), (F.lit(w) * (dbl(c) - F.col(f"_m_{c}"))).alias("phi"))
             for c, w in zip(features, weights)]
    return j.select(key, F.inline(F.array(*items)))


def top_contributions(attr: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(key, rank, feature, phi, direction): the ``k`` largest |phi| of each row (ties by feature name).

    A row has one entry per feature, so its entries are ranked as one small array.
    """
    items = attr.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.abs("phi")).alias("o"), "feature", "phi"))).alias("s"))
    top = items.select(key, F.posexplode(F.slice("s", 1, k)).alias("p", "x"))
    return top.select(key, (F.col("p") + 1).alias("rank"), F.col("x.feature").alias("feature"), F.col("x.phi").alias("phi"),
                      F.when(F.col("x.phi") > 0, "increases").otherwise("decreases").alias("direction"))


def local_narrative(top: DataFrame, key: str) -> DataFrame:
    """(key, narrative): a line per top contribution, in rank order.

    Above .1 in size 'strongly', above .05 'moderately', else 'slightly'.
    """
    size = F.abs("phi")
    mag = F.when(size > 0.1, "strongly").when(size > 0.05, "moderately").otherwise("slightly")
    sign = F.when(F.round("phi", 4) < 0, "").otherwise("+")
    line = F.concat(F.lit("- **"), "feature", F.lit("** "), mag, F.lit(" "), "direction", F.lit(" CVD risk (SHAP="), sign,
                    F.format_string("%.4f", "phi"), F.lit(")"))
    return (top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
            .select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("narrative")))


def noise_stability(records: DataFrame, features: list[str], key: str, predict, sigma: float = 0.01,
                    stable_above: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: rows, share of equal 0/1 predictions with and without noise, status.

    Noise is normal with deviation ``sigma``, made from hashes of key, feature
    and seed (Box-Muller), so a repeated run gives the same row. ``predict``
    maps {feature: column} to a 0/1 column.
    """
    def uniform(c: str, part: str):
        h = F.xxhash64(F.col(key).cast("string"), F.lit(c), F.lit(part), F.lit(seed))
        return (F.shiftrightunsigned(h, 11).cast("double") + 1.0) / F.lit(float(1 << 53) + 1.0)

    def noisy(c: str):
        return dbl(c) + sigma * F.sqrt(-2.0 * F.log(uniform(c, "r"))) * F.cos(2.0 * F.pi() * uniform(c, "a"))

    same = predict({c: dbl(c) for c in features}) == predict({c: noisy(c) for c in features})
    r = records.agg(F.count(F.lit(1)).alias("rows"), F.avg(same.cast("int")).alias("agreement"))
    return r.withColumn("status", F.when(F.col("agreement") > stable_above, "STABLE").otherwise("UNSTABLE"))


def global_importance(attr: DataFrame, top: int = 20) -> DataFrame:
    """Mean |phi| per feature, largest first (a top-n report)."""
    return (attr.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
            .orderBy(F.col("mean_abs_phi").desc(), "feature").limit(top))
