"""Registered model-evaluation queries (M-3, M-4, K-1, W-5, D-26, Q-1, M-17, Z-1, Z-2, Z-5, Z-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import metrics
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.registry import fixture, register

P = fx.predictions_sql()


def _preds(spark, sf_dir):
    return fixture(spark, sf_dir, P, "lineitem")


_CM = f"""WITH p AS ({P}),
c AS (SELECT model, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn,
             count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn
      FROM p GROUP BY model),
m AS (SELECT model, tp, tn, fp, fn,
             CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0) AS acc,
             CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS prec, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS rec,
             CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS spec, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
             (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
               / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc
      FROM c)"""

ORACLE_CLASSIFICATION = _CM + """
SELECT model, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(coalesce(acc, 0), 4) AS accuracy, round((coalesce(rec, 0) + coalesce(spec, 0)) / 2, 4) AS balanced_accuracy,
       round(coalesce(prec, 0), 4) AS precision, round(coalesce(rec, 0), 4) AS sensitivity,
       round(coalesce(spec, 0), 4) AS specificity, round(coalesce(f1, 0), 4) AS f1, round(coalesce(mcc, 0), 4) AS mcc
FROM m"""


@register("classification_metrics", ORACLE_CLASSIFICATION)
def q_classification(spark, sf_dir):
    """Confusion counts and threshold metrics of three rule-based models."""
    return metrics.classification_metrics(_preds(spark, sf_dir))


_AUC = f"""WITH p AS ({P}),
sc AS (SELECT model, prob AS score, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS n_pos FROM p GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                + (n + 1) / 2.0 AS mid FROM sc),
a AS (SELECT model, sum(n_pos) AS n1, sum(n - n_pos) AS n0, sum(mid * n_pos) AS r1 FROM r GROUP BY model),
auc AS (SELECT model, round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 4) AS roc_auc FROM a)"""

ORACLE_AUC = _AUC + "\nSELECT model, roc_auc FROM auc"


@register("roc_auc", ORACLE_AUC)
def q_roc_auc(spark, sf_dir):
    """Tie-aware ROC-AUC of three rule-based models (scores rounded, so ties occur)."""
    return metrics.roc_auc(_preds(spark, sf_dir))


_DESC = f"""WITH p AS ({P}),
c AS (SELECT model, prob AS score, count(*) AS n, sum(label) AS n_pos FROM p GROUP BY ALL),
d AS (SELECT *, sum(n_pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
              sum(n - n_pos) OVER (PARTITION BY model ORDER BY score DESC) AS fp,
              sum(n_pos) OVER (PARTITION BY model) AS tot_pos, sum(n - n_pos) OVER (PARTITION BY model) AS tot_neg FROM c)"""

ORACLE_ROC_CURVE = _DESC + """
SELECT model, score AS threshold, round(CAST(tp AS DOUBLE) / tot_pos, 6) AS tpr, round(CAST(fp AS DOUBLE) / tot_neg, 6) AS fpr,
       round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision FROM d"""


@register("roc_curve", ORACLE_ROC_CURVE)
def q_roc_curve(spark, sf_dir):
    """ROC / precision curve points at every distinct score of each model."""
    return metrics.roc_curve(_preds(spark, sf_dir))


ORACLE_PROB_METRICS = _DESC + """,
ap AS (SELECT model, sum(n_pos * CAST(tp AS DOUBLE) / (tp + fp)) / sum(n_pos) AS pr_auc FROM d GROUP BY model),
b AS (SELECT model, avg((prob - label) * (prob - label)) AS brier,
             -avg(label * ln(least(greatest(prob, 1e-15), 1 - 1e-15))
                  + (1 - label) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15))) AS log_loss,
             CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS DOUBLE) AS tp_,
             CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS DOUBLE) AS tn_,
             CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS DOUBLE) AS fp_,
             CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS DOUBLE) AS fn_ FROM p GROUP BY model),
k AS (SELECT *, (tp_ + tn_) / (tp_ + tn_ + fp_ + fn_) AS po,
             ((tp_ + fp_) * (tp_ + fn_) + (fn_ + tn_) * (fp_ + tn_)) / ((tp_ + tn_ + fp_ + fn_) * (tp_ + tn_ + fp_ + fn_)) AS pe
      FROM b)
SELECT k.model, round(brier, 4) AS brier, round(log_loss, 4) AS log_loss,
       round(coalesce((po - pe) / nullif(1 - pe, 0), 0), 4) AS kappa, round(pr_auc, 4) AS pr_auc
FROM k JOIN ap ON k.model = ap.model"""


@register("probability_metrics", ORACLE_PROB_METRICS)
def q_prob_metrics(spark, sf_dir):
    """Brier, log loss, Cohen's kappa and PR-AUC (average precision) per model."""
    return metrics.probability_metrics(_preds(spark, sf_dir))


ORACLE_CALIBRATION = f"""WITH p AS ({P})
SELECT model, least(CAST(floor(prob * 10) AS INTEGER) + 1, 10) AS bin, count(*) AS n,
       round(avg(prob), 4) AS mean_prob, round(avg(label), 4) AS observed_rate
FROM p GROUP BY ALL"""


@register("calibration_curve", ORACLE_CALIBRATION)
def q_calibration(spark, sf_dir):
    """Reliability table: mean probability vs observed rate in 10 bins."""
    return metrics.calibration(_preds(spark, sf_dir))


def _table(spark, sf_dir):
    p = _preds(spark, sf_dir)
    return metrics.model_table(p, positions=p.select("model", "pos").distinct())


def _nested_table() -> str:
    # classification metrics as a sub-select over the same predictions
    cm = ORACLE_CLASSIFICATION.split("\nSELECT model, CAST(tp")[1]
    inner = _CM.replace(f"WITH p AS ({P}),", "")
    return (f"WITH p AS ({P}),\n{inner.strip()},\n"
            "cmx AS (SELECT model, CAST(tp" + cm + "),\n"
            + _AUC.split(f"WITH p AS ({P}),")[1].strip() + ",\n"
            "pos AS (SELECT DISTINCT model, pos FROM p),\n"
            "t AS (SELECT cmx.*, auc.roc_auc, pos.pos FROM cmx JOIN auc ON cmx.model = auc.model "
            "JOIN pos ON pos.model = cmx.model)")


ORACLE_LEADERBOARD = _nested_table() + """
SELECT *, row_number() OVER (ORDER BY roc_auc DESC, f1 DESC, pos) AS rank FROM t"""


@register("leaderboard", ORACLE_LEADERBOARD)
def q_leaderboard(spark, sf_dir):
    """Models ranked by ROC-AUC, then F1, then declared order."""
    return metrics.leaderboard(_table(spark, sf_dir))


ORACLE_BEST = _nested_table() + "\nSELECT * FROM t ORDER BY roc_auc DESC, f1 DESC, pos LIMIT 1"


@register("best_model", ORACLE_BEST)
def q_best(spark, sf_dir):
    """The single best model (a top-1 report: the limit is the feature)."""
    return metrics.best_model(_table(spark, sf_dir))


ORACLE_GATE = _nested_table() + """
SELECT max(roc_auc) AS best_auc,
       CAST(count(*) FILTER (WHERE roc_auc >= 1 AND fp = 0 AND fn = 0) AS BIGINT) AS perfect_models,
       count(*) FILTER (WHERE roc_auc >= 1 AND fp = 0 AND fn = 0) >= 3 AS leakage,
       max(roc_auc) >= 0.75 AND count(*) FILTER (WHERE roc_auc >= 1 AND fp = 0 AND fn = 0) < 3 AS passed
FROM t"""


@register("model_gate", ORACLE_GATE)
def q_gate(spark, sf_dir):
    """AUC >= 0.75 gate with the perfect-model leakage signal."""
    return metrics.model_gate(_table(spark, sf_dir))


ORACLE_LEAK_SIGNAL = _nested_table() + """
SELECT CAST(count(*) FILTER (WHERE roc_auc >= 1 AND fp = 0 AND fn = 0) AS BIGINT) AS perfect_models,
       count(*) FILTER (WHERE roc_auc >= 1 AND fp = 0 AND fn = 0) >= 3 AS leakage FROM t"""


@register("leakage_signal", ORACLE_LEAK_SIGNAL)
def q_leak_signal(spark, sf_dir):
    """Count of perfect models (AUC 1, no FP/FN); three or more flag leakage."""
    return metrics.leakage_signal(_table(spark, sf_dir))


ORACLE_MODEL_CARD = _nested_table() + """
SELECT model, printf('Model %s reaches ROC-AUC %.4f, F1 %.4f, sensitivity %.4f and specificity %.4f (TP %d, TN %d, FP %d, FN %d).',
                     model, roc_auc, f1, sensitivity, specificity, tp, tn, fp, fn) AS summary FROM t"""


@register("model_card", ORACLE_MODEL_CARD)
def q_model_card(spark, sf_dir):
    """Model-card sentence per model."""
    return metrics.model_card(_table(spark, sf_dir))


ORACLE_COMPARISON = _nested_table() + "\n" + "\nUNION ALL ".join(
    f"SELECT model, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM t"
    for m in ("accuracy", "precision", "sensitivity", "specificity", "f1", "mcc", "roc_auc"))


@register("model_comparison", ORACLE_COMPARISON)
def q_comparison(spark, sf_dir):
    """Long (model, metric, value) comparison table."""
    return metrics.model_comparison(_table(spark, sf_dir))
