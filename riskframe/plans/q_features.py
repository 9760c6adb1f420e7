"""Registered feature-preparation and EDA queries (B-9..B-11, B-19, B-20,
D-2, D-10..D-15, D-19..D-21, M-5, W-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import eda, features
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.registry import fixture, register

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _vitals(spark, sf_dir):
    return fixture(spark, sf_dir, fx.VITALS, "customer")


def _li(spark, sf_dir):
    return fixture(spark, sf_dir, fx.LINEITEM_LABELLED, "lineitem")


ORACLE_FEATURES = f"""WITH v AS ({fx.VITALS}), m AS (SELECT avg(height) AS mh FROM v)
SELECT patient_id, ap_hi - ap_lo AS pulse_pressure,
       weight / ((CASE WHEN mh > 10 THEN height / 100.0 ELSE height END)
                 * (CASE WHEN mh > 10 THEN height / 100.0 ELSE height END)) AS bmi,
       CAST(floor(age / 10.0) AS INTEGER) AS age_decade,
       CAST(CAST(floor(age / 10.0) * 10 AS INTEGER) AS VARCHAR) || 's' AS age_group
FROM v, m"""


@register("feature_engineering", ORACLE_FEATURES)
def q_features(spark, sf_dir):
    """Pulse pressure, BMI with the dataset-level cm/m decision, age decade and band."""
    v = _vitals(spark, sf_dir)
    v = features.feature_decade(features.feature_ratio(features.feature_diff(v)))
    return v.select("patient_id", "pulse_pressure", F.round("bmi", 10).alias("bmi"), "age_decade",
                    features.age_group("age").alias("age_group"))


ORACLE_DROP_LEAKY = """SELECT o_orderkey AS order_id, o_totalprice AS total, o_orderstatus AS status FROM orders"""


@register("drop_leaky", ORACLE_DROP_LEAKY)
def q_drop_leaky(spark, sf_dir):
    """Blocklist drop: an exact leak name and two name-part matches go, the target stays."""
    from riskframe.plans.registry import views
    views(spark, sf_dir, "orders")
    df = spark.sql("SELECT o_orderkey AS order_id, o_custkey AS patient_id, o_totalprice AS total, "
                   "o_totalprice / 1000 AS risk_score_v1, o_orderpriority AS model_prediction, "
                   "o_orderstatus AS status FROM orders")
    return features.drop_leaky(df, target="status")


def _corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


ORACLE_TARGET_CORR = f"""WITH b AS ({fx.LINEITEM_LABELLED})
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round({_corr_sql(c, 'label')}, 4) AS corr, "
    f"round(abs({_corr_sql(c, 'label')}), 4) AS abs_corr FROM b" for c in LI_FEATURES)


@register("target_correlation", ORACLE_TARGET_CORR)
def q_target_corr(spark, sf_dir):
    """Pearson r of four line-item measures with the returned label."""
    return features.target_correlation(_li(spark, sf_dir), "label", LI_FEATURES)


_LEAK_FIX = f"""SELECT label, l_quantity, l_discount,
       2 * label + (l_orderkey % 5) * 0.001 AS leak_col, CAST(1.0 AS DOUBLE) AS const_col
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem) x"""

ORACLE_LEAKAGE = f"WITH b AS ({_LEAK_FIX})\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round({_corr_sql(c, 'label')}, 4) AS corr, "
    f"round(abs({_corr_sql(c, 'label')}), 4) AS abs_corr, "
    f"coalesce(round(abs({_corr_sql(c, 'label')}), 4) > 0.9, false) AS leak FROM b"
    for c in ["l_quantity", "l_discount", "leak_col", "const_col"])


@register("leakage_audit", ORACLE_LEAKAGE)
def q_leakage(spark, sf_dir):
    """|r| > 0.90 leakage flag; a planted leak column is caught, a constant gives NULL r."""
    df = fixture(spark, sf_dir, _LEAK_FIX, "lineitem")
    r = features.leakage_audit(df, "label", ["l_quantity", "l_discount", "leak_col", "const_col"])
    return r.withColumn("leak", F.coalesce(F.col("leak"), F.lit(False)))


ORACLE_CORR_MATRIX = f"WITH b AS ({fx.LINEITEM_LABELLED})\n" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round({_corr_sql(a, b)}, 2) AS corr FROM b"
    for a in LI_FEATURES for b in LI_FEATURES)


@register("correlation_matrix", ORACLE_CORR_MATRIX)
def q_corr_matrix(spark, sf_dir):
    """Long-form Pearson matrix of four line-item measures (2 dp)."""
    return features.correlation_matrix(_li(spark, sf_dir), LI_FEATURES)


SCALE_ROBUST = ["weight", "height"]
SCALE_STD = ["age", "ap_hi", "ap_lo", "c_acctbal"]

ORACLE_SCALE = f"""WITH v AS ({fx.VITALS}),
r AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}"
                        for c in SCALE_ROBUST)},
             {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in SCALE_STD)} FROM v)
SELECT patient_id,
       {", ".join(f"round(({c} - m_{c}) / CASE WHEN i_{c} = 0 THEN 1 ELSE i_{c} END, 6) AS {c}" for c in SCALE_ROBUST)},
       {", ".join(f"round(({c} - a_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in SCALE_STD)}
FROM v, r"""


@register("scale_features", ORACLE_SCALE)
def q_scale(spark, sf_dir):
    """Robust scaling (median / IQR) of columns whose names match the robust
    parts (weight, height here), standard scaling (mean / population sigma)
    of the rest."""
    v = _vitals(spark, sf_dir).select("patient_id", *SCALE_ROBUST, *SCALE_STD)
    cols = SCALE_ROBUST + SCALE_STD
    rob = features.robust_columns(cols)
    std = [c for c in cols if c not in rob]
    out = features.apply_scaling(v, features.robust_params(v, rob).unionByName(features.standard_params(v, std)))
    return out.select("patient_id", *[F.round(c, 6).alias(c) for c in SCALE_ROBUST + SCALE_STD])


ORACLE_ONE_HOT = """SELECT o_orderkey,
  CAST(coalesce(o_orderpriority = '2-HIGH', false) AS INTEGER) AS "o_orderpriority_2-HIGH",
  CAST(coalesce(o_orderpriority = '3-MEDIUM', false) AS INTEGER) AS "o_orderpriority_3-MEDIUM",
  CAST(coalesce(o_orderpriority = '4-NOT SPECIFIED', false) AS INTEGER) AS "o_orderpriority_4-NOT SPECIFIED",
  CAST(coalesce(o_orderpriority = '5-LOW', false) AS INTEGER) AS "o_orderpriority_5-LOW"
FROM orders"""


@register("one_hot", ORACLE_ONE_HOT)
def q_one_hot(spark, sf_dir):
    """Drop-first one-hot of order priority (levels found from the data, sorted)."""
    from riskframe.plans.registry import views
    views(spark, sf_dir, "orders")
    return features.one_hot(spark.table("orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


ORACLE_CLASS_DIST = f"""WITH v AS ({fx.VITALS}), c AS (SELECT cardio AS class, count(*) AS n FROM v GROUP BY cardio),
t AS (SELECT sum(n) AS tt, min(n) AS mn FROM c)
SELECT class, CAST(n AS BIGINT) AS n, round(n * 1.0 / tt, 3) AS share, round(mn * 100.0 / tt, 2) AS minority_pct FROM c, t"""


@register("class_distribution", ORACLE_CLASS_DIST)
def q_class_dist(spark, sf_dir):
    """Label counts, shares and minority share of the vitals table."""
    return eda.class_distribution(_vitals(spark, sf_dir), "cardio")


ORACLE_RATE = f"""WITH v AS ({fx.VITALS})
SELECT CAST(floor(age / 10.0) AS INTEGER) AS age_decade, count(*) AS n, round(avg(cardio) * 100.0, 1) AS rate_pct
FROM v GROUP BY 1"""


@register("rate_by_group", ORACLE_RATE)
def q_rate(spark, sf_dir):
    """Positive-label rate (%) by age decade."""
    v = features.feature_decade(_vitals(spark, sf_dir))
    return eda.rate_by_group(v, "age_decade", "cardio")


ORACLE_DESCRIBE = f"WITH b AS ({fx.LINEITEM_LABELLED})\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, "
    f"round(min({c}), 3) AS min, round(quantile_cont({c}, 0.25), 3) AS p25, round(quantile_cont({c}, 0.5), 3) AS p50, "
    f"round(quantile_cont({c}, 0.75), 3) AS p75, round(max({c}), 3) AS max FROM b" for c in LI_FEATURES)


@register("describe", ORACLE_DESCRIBE)
def q_describe(spark, sf_dir):
    """count / mean / std / min / quartiles / max of four measures (exact quartiles)."""
    return eda.describe(_li(spark, sf_dir), LI_FEATURES)


ORACLE_HIST = f"""WITH b AS ({fx.LINEITEM_LABELLED}),
long AS ({" UNION ALL ".join(f"SELECT label AS class, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM b"
                              for c in LI_FEATURES)}),
r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
x AS (SELECT long.feature, class, lo, hi, (hi - lo) / 20 AS w,
             CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS INTEGER) + 1, 20) END AS bin
      FROM long JOIN r ON long.feature = r.feature)
SELECT feature, class, bin, round(lo + (bin - 1) * w, 6) AS lo, round(lo + bin * w, 6) AS hi, count(*) AS n
FROM x GROUP BY feature, class, bin, lo, w"""


@register("histogram_by_class", ORACLE_HIST)
def q_hist(spark, sf_dir):
    """20-bin equal-width histograms per class over all rows."""
    return eda.histogram_by_class(_li(spark, sf_dir), "label", LI_FEATURES, 20)


ORACLE_BOX = f"""WITH b AS ({fx.LINEITEM_LABELLED}),
long AS ({" UNION ALL ".join(f"SELECT label AS class, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM b"
                              for c in LI_FEATURES)})
SELECT feature, class, quantile_cont(value, 0.0) AS min, quantile_cont(value, 0.25) AS q1,
       quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 1.0) AS max
FROM long GROUP BY feature, class"""


@register("box_by_class", ORACLE_BOX)
def q_box(spark, sf_dir):
    """Exact five-number summaries per feature and class."""
    return eda.box_by_class(_li(spark, sf_dir), "label", LI_FEATURES)


ORACLE_SAMPLE = """SELECT class, o_orderkey, o_totalprice, pos FROM (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS class, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END ORDER BY o_orderkey) AS pos
  FROM orders WHERE o_totalprice IS NOT NULL) x WHERE pos <= 2000"""


@register("sample_per_class", ORACLE_SAMPLE)
def q_sample(spark, sf_dir):
    """First 2000 order totals per status class in order-key order (the limit is the feature)."""
    df = fixture(spark, sf_dir, fx.ORDERS_LABELLED, "orders")
    return eda.sample_per_class(df, "label", "o_totalprice", ["o_orderkey"], 2000)
