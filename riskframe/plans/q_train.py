"""Registered training queries (M-1, M-6, X-2, X-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import metrics, train
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.registry import fixture, register
from riskframe.session import dealt

FEATURES = ["age", "height", "weight", "ap_hi", "ap_lo", "cholesterol", "gluc", "smoke", "alco", "active"]

ORACLE_SPLIT = f"""WITH v AS ({fx.VITALS}),
h AS (SELECT cardio, patient_id,
             row_number() OVER (PARTITION BY cardio ORDER BY substr(sha256(CAST(patient_id AS VARCHAR) || '|42'), 1, 15)) - 1 AS r,
             count(*) OVER (PARTITION BY cardio) AS size FROM v)
SELECT cardio, count(*) FILTER (WHERE r < round(size * 0.2)) AS test_rows, count(*) AS rows FROM h GROUP BY cardio"""


@register("stratified_split", ORACLE_SPLIT)
def q_split(spark, sf_dir):
    """Exact 80/20 stratified split by hash order: test rows per class."""
    v = fixture(spark, sf_dir, fx.VITALS, "customer")
    s = train.stratified_split(v, "cardio", "patient_id")
    return s.groupBy("cardio").agg(F.count_if("is_test").alias("test_rows"), F.count(F.lit(1)).alias("rows"))


def _acct_label(spark, sf_dir):
    # a label the vitals actually determine (pressure + age + cholesterol), so models have signal to learn
    v = fixture(spark, sf_dir, fx.VITALS, "customer")
    return v.withColumn("cardio", ((F.col("ap_hi") + F.col("age") + F.col("cholesterol") * 10) > 190).cast("int"))


@register("model_benchmark")
def q_benchmark(spark, sf_dir):
    """Fit five MLlib models on the train split, evaluate on the test split; a row
    per model with its status (rows-only)."""
    s = train.stratified_split(_acct_label(spark, sf_dir), "cardio", "patient_id")
    preds, status = train.benchmark(s, "cardio", FEATURES, "patient_id")
    return status.join(metrics.model_table(preds), "model", "left")


# Fixed weights, so that the attributions themselves can be checked.
WEIGHTS = {"age": 0.05, "height": -0.01, "weight": 0.02, "ap_hi": 0.06, "ap_lo": 0.01, "cholesterol": 0.5, "gluc": -0.1,
           "smoke": 0.2, "alco": -0.05, "active": -0.25}

_PHI_SQL = f"WITH v AS ({fx.VITALS}), a AS (" + " UNION ALL ".join(
    f"SELECT patient_id, '{c}' AS feature, {w} * (CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) AS phi FROM v"
    for c, w in WEIGHTS.items()) + ")"


def _attributions(spark, sf_dir):
    v = fixture(spark, sf_dir, fx.VITALS, "customer")
    return train.linear_attributions(v, list(WEIGHTS), list(WEIGHTS.values()), "patient_id")


@register("linear_attributions", _PHI_SQL + " SELECT patient_id, feature, round(phi, 6) AS phi FROM a")
def q_attr(spark, sf_dir):
    """Linear attributions phi = w (x - mean) of every patient and feature, for given weights."""
    return _attributions(spark, sf_dir).select("patient_id", "feature", F.round("phi", 6).alias("phi"))


@register("global_importance", _PHI_SQL + " SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM a GROUP BY feature")
def q_importance(spark, sf_dir):
    """Mean |phi| per feature."""
    return train.global_importance(_attributions(spark, sf_dir)).select("feature", F.round("mean_abs_phi", 6).alias("mean_abs_phi"))


@register("top_contributions", _PHI_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY abs(phi) DESC, feature) AS rank FROM a)
SELECT patient_id, rank, feature, CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM r WHERE rank <= 5""")
def q_top_contributions(spark, sf_dir):
    """The five largest contributions of every patient (the limit is the feature)."""
    return train.top_contributions(_attributions(spark, sf_dir), "patient_id").drop("phi")


@register("fitted_importance")
def q_fitted_importance(spark, sf_dir):
    """Global ranking of the attributions of a fitted logistic regression, with the
    benchmark's settings (rows-only)."""
    from pyspark.ml.feature import VectorAssembler
    d = dealt(_acct_label(spark, sf_dir))  # the fit passes over the rows again and again
    va = VectorAssembler(inputCols=FEATURES, outputCol="features")
    est = dict(train._models(d.count()))["LogisticRegression"]
    lr = est.fit(va.transform(d.withColumn("label", F.col("cardio").cast("double"))))
    return train.global_importance(train.linear_attributions(d, FEATURES, lr.coefficients.toArray().tolist(), "patient_id"))
