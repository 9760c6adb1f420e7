"""Registered explanation queries (X-1, X-3, X-6)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe.operators import explain, train
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.q_train import FEATURES, WEIGHTS, _acct_label
from riskframe.plans.registry import fixture, register
from riskframe.session import dealt

# A logistic score of the vitals with given weights, so that the contributions can be checked.
BIAS = -13.0
PAIRS, BACKGROUND = 2, 10

_LINEAR = " + ".join(f"{w} * CASE WHEN w.{c} <= step THEN v.{c} ELSE b.{c} END" for c, w in WEIGHTS.items())

ORACLE_SHAPLEY = f"""WITH v AS (SELECT patient_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in WEIGHTS)} FROM ({fx.VITALS}) x),
b AS (SELECT * FROM v ORDER BY sha256(CAST(patient_id AS VARCHAR) || '|42') LIMIT {BACKGROUND}),
o AS (SELECT p, f, row_number() OVER (PARTITION BY p ORDER BY sha256(p || '|' || f || '|42')) AS pos
      FROM range(0, {PAIRS}) r(p), (VALUES {", ".join(f"('{c}')" for c in WEIGHTS)}) n(f)),
d AS (SELECT p, 0 AS back, f, pos FROM o UNION ALL SELECT p, 1, f, {len(WEIGHTS) + 1} - pos FROM o),
w AS (SELECT p, back, {", ".join(f"max(pos) FILTER (WHERE f = '{c}') AS {c}" for c in WEIGHTS)} FROM d GROUP BY p, back),
s AS (SELECT v.patient_id, w.p, w.back, step, avg(1 / (1 + exp(-({_LINEAR} + ({BIAS}))))) AS score
      FROM v, b, w, range(0, {len(WEIGHTS) + 1}) r(step) GROUP BY v.patient_id, w.p, w.back, step)
SELECT x.patient_id, d.f AS feature, round(avg(x.score - y.score), 6) AS phi FROM d
JOIN s x ON x.p = d.p AND x.back = d.back AND x.step = d.pos
JOIN s y ON y.p = d.p AND y.back = d.back AND y.step = d.pos - 1 AND y.patient_id = x.patient_id GROUP BY x.patient_id, d.f"""


@register("sampled_shapley", ORACLE_SHAPLEY)
def q_shapley(spark, sf_dir):
    """Sampled Shapley values of every patient's logistic score against a background of ten patients."""
    v = fixture(spark, sf_dir, fx.VITALS, "customer")
    model = explain.logistic_model(list(WEIGHTS.values()), BIAS)
    got = explain.sampled_shapley(v, "patient_id", list(WEIGHTS), model, v, pairs=PAIRS, rows=BACKGROUND)
    return got.select("patient_id", "feature", F.round("phi", 6).alias("phi"))


@register("local_surrogate")
def q_surrogate(spark, sf_dir):
    """Local linear surrogates of every patient's logistic score (rows-only; tests solve the normal equations)."""
    v = fixture(spark, sf_dir, fx.VITALS, "customer")
    return explain.local_surrogate(v, "patient_id", list(WEIGHTS), explain.logistic_model(list(WEIGHTS.values()), BIAS))


@register("tree_attributions")
def q_tree_attributions(spark, sf_dir):
    """Path-dependent attributions of every patient under the benchmark's boosted trees (rows-only; tests go
    through all subsets of the features)."""
    d = dealt(_acct_label(spark, sf_dir))  # the fit passes over the rows again and again
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(d.withColumn("label", F.col("cardio").cast("double")))
    model = dict(train._models(0))["GradientBoosting"].fit(data)
    return explain.tree_attributions(d, "patient_id", FEATURES, explain.fitted_trees(model, spark))
