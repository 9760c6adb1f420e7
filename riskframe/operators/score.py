"""Bulk risk scoring (B-12..B-18, B-21, M-19): validation, closed-form score,
bands, rule-based factors and recommendation text — all column expressions,
applied to any number of rows at once (no per-record loop, no batch cap).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import dbl


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# fixed values: accepted input ranges per field (inclusive)
INPUT_RANGES = {
    "age": (1, 120), "gender": (1, 2), "height": (100, 250), "weight": (20, 300),
    "ap_hi": (60, 250), "ap_lo": (40, 180), "cholesterol": (1, 3), "gluc": (1, 3),
    "smoke": (0, 1), "alco": (0, 1), "active": (0, 1),
}


def validate_rows(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None,
                  check_bp_order: bool = True) -> DataFrame:
    """Add ``violations`` ARRAY<STRING> (rule names) and ``valid``.

    A NULL field violates its range rule; ``ap_hi > ap_lo`` is an extra rule
    (the single-record path checks it, the batch path did not — here it is a
    switch).
    """
    ranges = INPUT_RANGES if ranges is None else ranges
    rules = [F.when(~F.coalesce(dbl(c).between(lo, hi), F.lit(False)), F.lit(f"{c}_range"))
             for c, (lo, hi) in ranges.items() if c in df.columns]
    if check_bp_order and "ap_hi" in df.columns and "ap_lo" in df.columns:
        rules.append(F.when(~F.coalesce(F.col("ap_hi") > F.col("ap_lo"), F.lit(False)), F.lit("ap_hi_gt_ap_lo")))
    v = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return df.withColumn("violations", v).withColumn("valid", F.size("violations") == 0)


def heuristic_score(age="age", ap_hi="ap_hi", ap_lo="ap_lo", cholesterol="cholesterol", gluc="gluc",
                    active="active", smoke="smoke") -> Column:
    """Closed-form fallback probability, clamped to [0.05, 0.95]."""
    base = (0.1 + dbl(age) / 100.0 + (dbl(ap_hi) + dbl(ap_lo) - 120.0) / 100.0
            + dbl(cholesterol) * 0.15 + dbl(gluc) * 0.1
            + F.when(_c(active) == 0, 0.1).otherwise(0.0) + F.when(_c(smoke) == 1, 0.12).otherwise(0.0))
    return F.least(F.greatest(base, F.lit(0.05)), F.lit(0.95))


def heuristic_band(prob) -> Column:
    p = _c(prob)
    return F.when(p >= 0.7, "HIGH").when(p >= 0.4, "MODERATE").otherwise("LOW")


def risk_band(prob) -> Column:
    """>= .75 HIGH, >= .55 MODERATE-HIGH, >= .40 MODERATE, else LOW."""
    p = _c(prob)
    return (F.when(p >= 0.75, "HIGH").when(p >= 0.55, "MODERATE-HIGH").when(p >= 0.40, "MODERATE")
            .otherwise("LOW"))


def band_confidence(prob) -> Column:
    p = _c(prob)
    return (F.when(p >= 0.75, "Low — model is confident in high-risk classification")
            .when(p >= 0.55, "Moderate — borderline prediction, clinical review advised")
            .when(p >= 0.40, "Moderate — further assessment recommended")
            .otherwise("High — model is confident in low-risk classification"))


def dashboard_bands(prob) -> tuple[Column, Column, Column]:
    """(colour, label, class) of the dashboard; fixed values."""
    p = _c(prob)
    colour = F.when(p >= 0.65, "#e74c3c").when(p >= 0.45, "#e67e22").otherwise("#27ae60")
    label = (F.when(p >= 0.75, "HIGH RISK").when(p >= 0.55, "MODERATE-HIGH").when(p >= 0.40, "MODERATE")
             .otherwise("LOW RISK"))
    klass = F.when(p >= 0.55, "high").when(p >= 0.40, "moderate").otherwise("low")
    return colour, label, klass


def bmi_of(weight="weight", height="height") -> Column:
    return dbl(weight) / F.pow(dbl(height) / 100.0, 2)


def _factor(cond: Column, factor: str, value: Column, status: str, impact: str) -> Column:
    return F.when(cond, F.struct(F.lit(factor).alias("factor"), value.alias("value"),
                                 F.lit(status).alias("status"), F.lit(impact).alias("impact")))


def risk_factors(max_items: int = 6) -> Column:
    """Ordered rule list -> ARRAY<STRUCT<factor, value, status, impact>>, first ``max_items``;
    'No major risk factors identified' when none applies."""
    bmi = bmi_of()
    items = [
        _factor(F.col("ap_hi") >= 140, "Systolic BP", F.format_string("%s mmHg", F.col("ap_hi")), "HIGH",
                "strong_positive"),
        _factor(F.col("ap_lo") >= 90, "Diastolic BP", F.format_string("%s mmHg", F.col("ap_lo")), "ELEVATED",
                "moderate_positive"),
        _factor(F.col("cholesterol") == 3, "Cholesterol", F.lit("Well above normal"), "HIGH", "strong_positive"),
        _factor(F.col("cholesterol") == 2, "Cholesterol", F.lit("Above normal"), "ELEVATED", "moderate_positive"),
        _factor(F.col("smoke") == 1, "Smoking", F.lit("Active smoker"), "RISK", "moderate_positive"),
        _factor(F.col("gluc") >= 2, "Glucose", F.lit("Elevated"), "ELEVATED", "moderate_positive"),
        _factor(bmi >= 30, "BMI", F.format_string("%.1f (Obese)", bmi), "HIGH", "moderate_positive"),
        _factor((bmi >= 25) & (bmi < 30), "BMI", F.format_string("%.1f (Overweight)", bmi), "ELEVATED",
                "mild_positive"),
        _factor(F.col("active") == 0, "Physical Activity", F.lit("Sedentary"), "RISK", "mild_positive"),
        _factor(F.col("age") >= 60, "Age", F.format_string("%d years", dbl("age").cast("int")), "ELEVATED",
                "moderate_positive"),
    ]
    found = F.filter(F.array(*items), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("Profile").alias("factor"), F.lit("No major risk factors identified").alias("value"),
                            F.lit("NORMAL").alias("status"), F.lit("none").alias("impact")))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(none), 1, max_items)


def factor_status(df: DataFrame, key: str) -> DataFrame:
    """Long (key, measure, value, status): NORMAL / ELEVATED / HIGH per measure."""
    def st(v: Column, high: float, elev: float) -> Column:
        return F.when(v >= high, "HIGH").when(v >= elev, "ELEVATED").otherwise("NORMAL")
    pp = dbl("ap_hi") - dbl("ap_lo")
    bmi = bmi_of()
    items = [F.struct(F.lit(m).alias("measure"), v.alias("value"), st(v, h, e).alias("status"))
             for m, v, h, e in [("Systolic BP", dbl("ap_hi"), 140, 130), ("Diastolic BP", dbl("ap_lo"), 90, 80),
                                ("BMI", bmi, 30, 25), ("Pulse Pressure", pp, 60, 50)]]
    return df.select(key, F.inline(F.array(*items)))


def recommendation(prob) -> Column:
    """Template text by band; HIGH lists the applicable actions."""
    p = _c(prob)
    acts = F.filter(F.array(F.when(F.col("ap_hi") >= 140, F.lit("hypertension management")),
                            F.when(F.col("cholesterol") >= 2, F.lit("lipid-lowering therapy")),
                            F.when(F.col("smoke") == 1, F.lit("smoking cessation program")),
                            F.when(F.col("active") == 0, F.lit("supervised exercise program"))),
                    lambda x: x.isNotNull())
    high = F.concat(F.lit("URGENT: High CVD risk detected. Recommend immediate cardiology referral, "),
                    F.when(F.size(acts) > 0, F.array_join(acts, ", "))
                    .otherwise(F.lit("comprehensive cardiovascular workup")),
                    F.lit(". Follow Australian Heart Foundation guidelines."))
    return (F.when(p >= 0.75, high)
            .when(p >= 0.55, F.lit("ELEVATED RISK: Schedule cardiology consultation within 4 weeks. "
                                   "Monitor blood pressure, cholesterol, and lifestyle factors. "
                                   "Consider preventive medication per NHFA guidelines."))
            .when(p >= 0.40, F.lit("BORDERLINE: Annual cardiovascular screening recommended. "
                                   "Lifestyle modification advised: diet, exercise, smoking cessation if applicable."))
            .otherwise(F.lit("LOW RISK: Continue routine health monitoring. "
                             "Annual check-up with GP. Maintain healthy lifestyle.")))


def batch_score(df: DataFrame, prob: Column | None = None, check_bp_order: bool = False) -> DataFrame:
    """validate -> score -> band -> factors -> recommendation for every row.

    ``prob`` defaults to the closed-form score; a fitted model's probability
    column can be passed instead. Rejected rows keep their violations and get
    no score.
    """
    v = validate_rows(df, check_bp_order=check_bp_order)
    p = heuristic_score() if prob is None else prob
    return (v.withColumn("probability", F.when(F.col("valid"), p))
            .withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
            .withColumn("risk_level", F.when(F.col("valid"), risk_band("probability")))
            .withColumn("confidence", F.when(F.col("valid"), band_confidence("probability")))
            .withColumn("top_risk_factors", F.when(F.col("valid"), risk_factors()))
            .withColumn("recommendation", F.when(F.col("valid"), recommendation("probability"))))
