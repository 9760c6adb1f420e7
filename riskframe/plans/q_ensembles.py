"""Registered ensemble queries (M-2, M-11, M-12, M-14, M-15, M-16): the models of the benchmark beyond ``model_benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import ensembles, explain, kernel_svm, metrics, neighbours, train
from riskframe.plans.q_train import FEATURES, _acct_label
from riskframe.plans.registry import register
from riskframe.session import written


@register("ensemble_benchmark")
def q_ensembles(spark, sf_dir):
    """Neighbour vote, AdaBoost, extra trees, second-order boosting and a kernel machine, fitted on the training
    rows (oversampled where a class is rare) and evaluated on the test rows (rows-only;
    tests grow the same trees by trying every split)."""
    rows = written(train.stratified_split(_acct_label(spark, sf_dir), "cardio", "patient_id")
                   .select("patient_id", "cardio", "is_test", *FEATURES), "split")
    fit, test = rows.where("NOT is_test"), rows.where("is_test")
    even = neighbours.oversample(fit, "cardio", "patient_id", FEATURES)
    even = written(even.withColumn("patient_id", F.monotonically_increasing_id()).select("patient_id", "cardio", *FEATURES), "even")
    models = [("AdaBoost", ensembles.adaboost(even, "cardio", FEATURES, rounds=20)),
              ("ExtraTrees", ensembles.extra_trees(even, "cardio", FEATURES, trees=20)),
              ("SecondOrderBoosting", ensembles.boosted_trees(even, "cardio", FEATURES, rounds=10, depth=4))]
    columns = [F.col("cardio").alias("label"), "prob", F.col("pred").cast("int").alias("pred")]
    preds = neighbours.knn_vote(even, test, "patient_id", FEATURES, "cardio").select(F.lit("KNN").alias("model"), F.lit(1).alias("pos"), *columns)
    machine = kernel_svm.fit_kernel_svm(even, "patient_id", "cardio", FEATURES)
    got = explain.scored(test, "patient_id", FEATURES, machine, ["cardio"])
    preds = preds.unionByName(got.select(F.lit("KernelSVM").alias("model"), F.lit(5).alias("pos"), *columns))
    for pos, (name, model) in enumerate(models, start=2):
        got = ensembles.scored(test, "patient_id", model, ["cardio"])
        preds = preds.unionByName(got.select(F.lit(name).alias("model"), F.lit(pos).alias("pos"), *columns))
    return metrics.model_table(written(preds, "predictions"))
