"""Model evaluation over a predictions table (M-3, M-4, K-1, W-5, D-26, Q-1,
M-17, Z-1, Z-2, Z-7).

A predictions table has one row per (model, record): the model name, the 0/1
label, a probability/score and a 0/1 prediction. Every metric is a grouped
aggregate per model; rank-based ones (ROC-AUC, PR-AUC, curves) use the
pre-aggregated (model, score) table and two-level cumulative counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import dbl
from riskframe.operators.ranks import cumulative_before, mid_ranks


def _z(c):
    """0 instead of NULL for an empty denominator."""
    return F.coalesce(c, F.lit(0.0))


def confusion(preds: DataFrame, model: str = "model", label: str = "label", pred: str = "pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return preds.groupBy(model).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def classification_metrics(preds: DataFrame, model: str = "model", label: str = "label",
                           pred: str = "pred") -> DataFrame:
    """tp/tn/fp/fn, accuracy, balanced accuracy, precision, recall = sensitivity,
    specificity, F1 and MCC per model, 4 dp; 0 where a denominator is 0."""
    c = confusion(preds, model, label, pred)
    tp, tn, fp, fn = (dbl(x) for x in ("tp", "tn", "fp", "fn"))
    acc = F.try_divide(tp + tn, tp + tn + fp + fn)
    prec = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    spec = F.try_divide(tn, tn + fp)
    f1 = F.try_divide(2.0 * tp, 2.0 * tp + fp + fn)
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(model, *[F.col(x).cast("long").alias(x) for x in ("tp", "tn", "fp", "fn")],
                    F.round(_z(acc), 4).alias("accuracy"),
                    F.round((_z(rec) + _z(spec)) / 2.0, 4).alias("balanced_accuracy"),
                    F.round(_z(prec), 4).alias("precision"), F.round(_z(rec), 4).alias("sensitivity"),
                    F.round(_z(spec), 4).alias("specificity"), F.round(_z(f1), 4).alias("f1"),
                    F.round(_z(mcc), 4).alias("mcc"))


def _score_counts(preds: DataFrame, model: str, label: str, score: str) -> DataFrame:
    return (preds.where(F.col(score).isNotNull() & F.col(label).isin(0, 1))
            .groupBy(F.col(model).alias("model"), dbl(score).alias("score"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos")))


def roc_auc(preds: DataFrame, model: str = "model", label: str = "label", score: str = "prob") -> DataFrame:
    """Tie-aware ROC-AUC = U / (n1 n0) per model, 4 dp."""
    r = mid_ranks(_score_counts(preds, model, label, score), ["model"], "score", "n")
    s = r.groupBy("model").agg(F.sum("n_pos").alias("n1"), F.sum(F.col("n") - F.col("n_pos")).alias("n0"),
                               F.sum(F.col("mid_rank") * F.col("n_pos")).alias("r1"))
    u = F.col("r1") - dbl("n1") * (dbl("n1") + 1.0) / 2.0
    return s.select(F.col("model").alias(model), F.round(F.try_divide(u, dbl("n1") * dbl("n0")), 4).alias("roc_auc"))


def _desc_cumulative(preds: DataFrame, model: str, label: str, score: str) -> DataFrame:
    """(model, score, n, n_pos, tp, fp): counts with score >= threshold (descending sweep)."""
    c = _score_counts(preds, model, label, score).withColumn("neg_score", -F.col("score"))
    c = c.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    j = cumulative_before(c, ["model"], "neg_score", {"pos_before": "n_pos", "neg_before": "n_neg"})
    return j.select("model", "score", "n", "n_pos",
                    (F.col("pos_before") + F.col("n_pos")).alias("tp"),
                    (F.col("neg_before") + F.col("n_neg")).alias("fp"))


def roc_curve(preds: DataFrame, model: str = "model", label: str = "label", score: str = "prob") -> DataFrame:
    """(model, threshold, tpr, fpr, precision) at every distinct score, 6 dp."""
    d = _desc_cumulative(preds, model, label, score)
    tot = d.groupBy("model").agg(F.sum("n_pos").alias("tot_pos"),
                                 F.sum(F.col("n") - F.col("n_pos")).alias("tot_neg"))
    j = d.join(F.broadcast(tot), "model")  # one row per model
    return j.select(F.col("model").alias(model), F.col("score").alias("threshold"),
                    F.round(F.try_divide(dbl("tp"), dbl("tot_pos")), 6).alias("tpr"),
                    F.round(F.try_divide(dbl("fp"), dbl("tot_neg")), 6).alias("fpr"),
                    F.round(F.try_divide(dbl("tp"), dbl("tp") + dbl("fp")), 6).alias("precision"))


def probability_metrics(preds: DataFrame, model: str = "model", label: str = "label", score: str = "prob",
                        pred: str = "pred", eps: float = 1e-15) -> DataFrame:
    """Brier score, log loss (p clipped to [eps, 1 - eps]), Cohen's kappa and
    PR-AUC as average precision (sum over thresholds of recall gain x precision)."""
    y, p = dbl(label), F.least(F.greatest(dbl(score), F.lit(eps)), F.lit(1.0 - eps))
    base = preds.groupBy(F.col(model).alias("model")).agg(
        F.avg(F.pow(dbl(score) - y, 2)).alias("brier"),
        (-F.avg(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))).alias("log_loss"))
    c = confusion(preds, model, label, pred).withColumnRenamed(model, "model")
    tp, tn, fp, fn = (dbl(x) for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    kappa = c.select("model", F.try_divide(po - pe, 1.0 - pe).alias("kappa"))
    d = _desc_cumulative(preds, model, label, score)
    ap = (d.groupBy("model").agg(
        F.try_divide(F.sum(F.col("n_pos") * F.try_divide(dbl("tp"), dbl("tp") + dbl("fp"))),
                     F.sum("n_pos")).alias("pr_auc")))
    return (base.join(kappa, "model").join(ap, "model")
            .select(F.col("model").alias(model), F.round("brier", 4).alias("brier"),
                    F.round("log_loss", 4).alias("log_loss"), F.round(_z(F.col("kappa")), 4).alias("kappa"),
                    F.round("pr_auc", 4).alias("pr_auc")))


def calibration(preds: DataFrame, model: str = "model", label: str = "label", score: str = "prob",
                bins: int = 10) -> DataFrame:
    """(model, bin, n, mean_prob, observed_rate) over equal-width probability bins."""
    b = F.least(F.floor(dbl(score) * bins).cast("int") + 1, F.lit(bins))
    return (preds.where(F.col(score).isNotNull())
            .groupBy(F.col(model).alias(model), b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dbl(score)), 4).alias("mean_prob"),
                 F.round(F.avg(dbl(label)), 4).alias("observed_rate")))


def model_table(preds: DataFrame, model: str = "model", label: str = "label", score: str = "prob",
                pred: str = "pred", positions: DataFrame | None = None) -> DataFrame:
    """Classification metrics + ROC-AUC per model (one row per model)."""
    m = classification_metrics(preds, model, label, pred).join(roc_auc(preds, model, label, score), model)
    if positions is not None:
        m = m.join(positions, model)
    return m


def leaderboard(metrics: DataFrame, model: str = "model", pos: str = "pos") -> DataFrame:
    """Rank models by ROC-AUC desc, F1 desc, declared position (one row per model: tiny)."""
    w = Window.orderBy(F.col("roc_auc").desc(), F.col("f1").desc(), F.col(pos))
    return metrics.withColumn("rank", F.row_number().over(w))


def best_model(metrics: DataFrame, pos: str = "pos") -> DataFrame:
    """Max ROC-AUC; ties -> higher F1, then declared order (a top-1 report)."""
    return metrics.orderBy(F.col("roc_auc").desc(), F.col("f1").desc(), F.col(pos)).limit(1)


def leakage_signal(metrics: DataFrame, min_perfect: int = 3) -> DataFrame:
    """Models with AUC >= 1 and FP = FN = 0; ``min_perfect`` or more signal leakage."""
    perfect = (F.col("roc_auc") >= 1.0) & (F.col("fp") == 0) & (F.col("fn") == 0)
    return metrics.agg(F.count_if(perfect).alias("perfect_models")).select(
        F.col("perfect_models").cast("long"), (F.col("perfect_models") >= min_perfect).alias("leakage"))


def model_gate(metrics: DataFrame, min_auc: float = 0.75, min_perfect: int = 3) -> DataFrame:
    """Gate on the best AUC (>= ``min_auc``) and no leakage signal."""
    perfect = (F.col("roc_auc") >= 1.0) & (F.col("fp") == 0) & (F.col("fn") == 0)
    a = metrics.agg(F.max("roc_auc").alias("best_auc"), F.count_if(perfect).alias("perfect_models"))
    return a.select("best_auc", F.col("perfect_models").cast("long"),
                    (F.col("perfect_models") >= min_perfect).alias("leakage"),
                    ((F.col("best_auc") >= min_auc) & (F.col("perfect_models") < min_perfect)).alias("passed"))


def model_card(best: DataFrame, model: str = "model") -> DataFrame:
    """One text row per model: headline metrics as sentences."""
    return best.select(
        model,
        F.format_string("Model %s reaches ROC-AUC %.4f, F1 %.4f, sensitivity %.4f and specificity %.4f "
                        "(TP %d, TN %d, FP %d, FN %d).", F.col(model), "roc_auc", "f1", "sensitivity",
                        "specificity", "tp", "tn", "fp", "fn").alias("summary"))


def model_comparison(metrics: DataFrame, model: str = "model",
                     names=("accuracy", "precision", "sensitivity", "specificity", "f1", "mcc", "roc_auc")) -> DataFrame:
    """Long (model, metric, value) view of the metrics table for side-by-side comparison."""
    m = metrics.select(model, *[dbl(n).alias(n) for n in names])
    return m.unpivot([model], list(names), "metric", "value")
