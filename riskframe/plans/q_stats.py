"""Registered hypothesis-test queries (D-16..D-18, Z-3..Z-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import stats
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.registry import fixture, register

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_LONG_SQL = f"""
WITH base AS ({fx.LINEITEM_LABELLED}),
long AS (
  SELECT label, 'l_quantity' AS feature, CAST(l_quantity AS DOUBLE) AS value FROM base
  UNION ALL SELECT label, 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM base
  UNION ALL SELECT label, 'l_discount', CAST(l_discount AS DOUBLE) FROM base
  UNION ALL SELECT label, 'l_tax', CAST(l_tax AS DOUBLE) FROM base),
c AS (SELECT feature, value, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS n_pos
      FROM long WHERE value IS NOT NULL AND label IN (0, 1) GROUP BY feature, value),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature ORDER BY value
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS mid
      FROM c),
per AS (SELECT feature, sum(n_pos) AS n1, sum(n - n_pos) AS n0, sum(mid * n_pos) AS r1,
               sum(n * n * n - n) AS ties,
               sum(value * n_pos) / sum(n_pos) AS m1, sum(value * (n - n_pos)) / sum(n - n_pos) AS m0
        FROM r GROUP BY feature),
ss AS (SELECT c.feature, sum((value - m1) * (value - m1) * n_pos) AS ss1,
              sum((value - m0) * (value - m0) * (n - n_pos)) AS ss0
       FROM c JOIN per USING (feature) GROUP BY c.feature),
fin AS (SELECT per.*, ss.ss1, ss.ss0, r1 - n1 * (n1 + 1) / 2.0 AS u1,
               sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sigma
        FROM per JOIN ss USING (feature))
"""

ORACLE_MANN_WHITNEY = _LONG_SQL + """
SELECT feature, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg,
       round(m1, 4) AS mean_pos, round(m0, 4) AS mean_neg, round(u1, 4) AS u_stat,
       round((greatest(u1, n1 * n0 - u1) - n1 * n0 / 2.0 - 0.5) / sigma, 4) AS u_z
FROM fin
"""

ORACLE_T_TEST = _LONG_SQL + """
SELECT feature, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg,
       round(m1, 4) AS mean_pos, round(m0, 4) AS mean_neg,
       round((m1 - m0) / sqrt((ss1 + ss0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 4) AS t_stat,
       CAST(n1 + n0 - 2 AS BIGINT) AS dof
FROM fin
"""


def _li(spark, sf_dir):
    return fixture(spark, sf_dir, fx.LINEITEM_LABELLED, "lineitem")


@register("mann_whitney", ORACLE_MANN_WHITNEY)
def q_mann_whitney(spark, sf_dir):
    """Mann-Whitney U of returned ('R') vs other line items for four measures."""
    return stats.mann_whitney(_li(spark, sf_dir), "label", LI_FEATURES)


@register("t_test", ORACLE_T_TEST)
def q_t_test(spark, sf_dir):
    """Pooled-variance two-sample t of returned vs other line items."""
    return stats.t_test(_li(spark, sf_dir), "label", LI_FEATURES)


def _significance(spark, sf_dir):
    u = stats.mann_whitney(_li(spark, sf_dir), "label", LI_FEATURES, with_p=True).select("feature", "u_stat", "u_p")
    t = stats.t_test(_li(spark, sf_dir), "label", LI_FEATURES, with_p=True).select("feature", "t_stat", "t_p")
    return stats.rank_by_p(u.join(t, "feature"), "u_p")


@register("significance")
def q_significance(spark, sf_dir):
    """p-values, significance labels and p-rank of both tests (rows-only check).

    u_p uses the normal approximation with tie and continuity correction; t_p
    the Student t distribution; both in a pandas UDF over one row per feature.
    """
    return _significance(spark, sf_dir).select(
        "feature", "u_stat", "u_p", "p_rank", "t_stat", "t_p", stats.significance_label("u_p").alias("u_label"),
        (F.col("u_p") < 0.05).alias("u_significant"), (F.col("t_p") < 0.05).alias("t_significant"))


@register("significant_count")
def q_significant_count(spark, sf_dir):
    """Number of features with p < .05 by either test (rows-only check)."""
    return _significance(spark, sf_dir).agg(
        F.count_if(F.col("u_p") < 0.05).alias("u_significant"), F.count_if(F.col("t_p") < 0.05).alias("t_significant"))


ORACLE_CHI_SQUARE = f"""
WITH base AS ({fx.ORDERS_LABELLED}),
long AS (
  SELECT CAST(label AS STRING) AS lab, 'o_orderpriority' AS feature, o_orderpriority AS value FROM base
  UNION ALL SELECT CAST(label AS STRING), 'price_band', price_band FROM base
  UNION ALL SELECT CAST(label AS STRING), 'order_year', order_year FROM base),
cells AS (SELECT feature, value, lab, count(*) AS o FROM long WHERE value IS NOT NULL GROUP BY ALL),
rt AS (SELECT feature, value, sum(o) AS rt FROM cells GROUP BY ALL),
ct AS (SELECT feature, lab, sum(o) AS ct FROM cells GROUP BY ALL),
dims AS (SELECT feature, sum(o) AS nt, count(DISTINCT value) AS nr, count(DISTINCT lab) AS nc
         FROM cells GROUP BY ALL),
grid AS (SELECT rt.feature, rt.value, ct.lab, coalesce(cells.o, 0) AS o,
                CAST(rt AS DOUBLE) * ct / nt AS e, (nr - 1) * (nc - 1) AS dof
         FROM rt JOIN ct ON rt.feature = ct.feature JOIN dims ON dims.feature = rt.feature
         LEFT JOIN cells ON cells.feature = rt.feature AND cells.value = rt.value AND cells.lab = ct.lab),
d AS (SELECT feature, dof, e,
             CASE WHEN dof = 1 THEN greatest(abs(o - e) - least(0.5, abs(o - e)), 0) ELSE abs(o - e) END AS diff
      FROM grid)
SELECT feature, round(sum(diff * diff / e), 4) AS chi2, CAST(max(dof) AS BIGINT) AS dof
FROM d GROUP BY feature
"""


@register("chi_square", ORACLE_CHI_SQUARE)
def q_chi_square(spark, sf_dir):
    """Chi-square of order status ('F') against priority, price band and year."""
    df = fixture(spark, sf_dir, fx.ORDERS_LABELLED, "orders")
    return stats.chi_square(df, "label", ["o_orderpriority", "price_band", "order_year"])


_GROUP_LONG = f"""
WITH base AS ({fx.LINEITEM_LABELLED}),
long AS (
  SELECT l_returnflag AS g, 'l_quantity' AS feature, CAST(l_quantity AS DOUBLE) AS value FROM base
  UNION ALL SELECT l_returnflag, 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM base
  UNION ALL SELECT l_returnflag, 'l_discount', CAST(l_discount AS DOUBLE) FROM base
  UNION ALL SELECT l_returnflag, 'l_tax', CAST(l_tax AS DOUBLE) FROM base)
"""

ORACLE_ANOVA = _GROUP_LONG + """,
g AS (SELECT feature, g, count(*) AS ng, avg(value) AS mg, var_pop(value) * count(*) AS ssw_g
      FROM long WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT feature, sum(ng) AS n, count(*) AS k, sum(mg * ng) / sum(ng) AS gm FROM g GROUP BY ALL),
s AS (SELECT g.feature, t.n, t.k, sum(ng * (mg - gm) * (mg - gm)) AS ssb, sum(ssw_g) AS ssw
      FROM g JOIN t USING (feature) GROUP BY ALL)
SELECT feature, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n,
       round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f_stat,
       CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within
FROM s
"""


@register("anova_f", ORACLE_ANOVA)
def q_anova(spark, sf_dir):
    """One-way ANOVA of four line-item measures across return flags."""
    df = fixture(spark, sf_dir, fx.LINEITEM_LABELLED, "lineitem")
    return stats.anova_f(df, "l_returnflag", LI_FEATURES)


ORACLE_KRUSKAL = _GROUP_LONG + """,
cells AS (SELECT feature, value, g, CAST(count(*) AS DOUBLE) AS ng FROM long WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT feature, value, sum(ng) AS n FROM cells GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature ORDER BY value
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS mid FROM c),
ties AS (SELECT feature, sum(n) AS nt, sum(n * n * n - n) AS tt FROM r GROUP BY ALL),
rg AS (SELECT cells.feature, g, sum(mid * ng) AS rg, sum(ng) AS ng
       FROM cells JOIN r ON cells.feature = r.feature AND cells.value = r.value GROUP BY ALL),
s AS (SELECT feature, sum(rg * rg / ng) AS srn, count(*) AS k FROM rg GROUP BY ALL)
SELECT s.feature, CAST(k AS BIGINT) AS k, CAST(nt AS BIGINT) AS n,
       round((12.0 / (nt * (nt + 1)) * srn - 3 * (nt + 1)) / (1 - tt / (nt * nt * nt - nt)), 4) AS h_stat,
       CAST(k - 1 AS BIGINT) AS dof
FROM s JOIN ties USING (feature)
"""


@register("kruskal_wallis", ORACLE_KRUSKAL)
def q_kruskal(spark, sf_dir):
    """Kruskal-Wallis H of four line-item measures across return flags."""
    df = fixture(spark, sf_dir, fx.LINEITEM_LABELLED, "lineitem")
    return stats.kruskal_wallis(df, "l_returnflag", LI_FEATURES)


# two rule-based "models" over line items, compared on the returned label
_TWO_MODELS = f"""
SELECT label, l_linestatus,
       l_quantity / 50.0 + l_discount * 5 AS score_a,
       l_tax * 10 + l_quantity / 100.0 AS score_b,
       CASE WHEN l_quantity / 50.0 + l_discount * 5 >= 0.75 THEN 1 ELSE 0 END AS pred_a,
       CASE WHEN l_tax * 10 + l_quantity / 100.0 >= 0.5 THEN 1 ELSE 0 END AS pred_b
FROM ({fx.LINEITEM_LABELLED}) b
"""

ORACLE_MCNEMAR = f"""
WITH p AS ({_TWO_MODELS}),
s AS (SELECT count(*) AS n,
             count(*) FILTER (WHERE pred_a = label AND pred_b <> label) AS b01,
             count(*) FILTER (WHERE pred_a <> label AND pred_b = label) AS b10 FROM p)
SELECT CAST(n AS BIGINT) AS n, CAST(b01 AS BIGINT) AS b01, CAST(b10 AS BIGINT) AS b10,
       round(power(greatest(abs(b01 - b10) - 1, 0), 2) / CAST(b01 + b10 AS DOUBLE), 4) AS chi2
FROM s
"""


@register("mcnemar", ORACLE_MCNEMAR)
def q_mcnemar(spark, sf_dir):
    """McNemar test between two rule-based classifiers on the returned label."""
    df = fixture(spark, sf_dir, _TWO_MODELS, "lineitem")
    return stats.mcnemar(df, "pred_a", "pred_b", "label")


ORACLE_WILCOXON = f"""
WITH p AS ({_TWO_MODELS}),
d AS (SELECT l_linestatus, score_a - score_b AS d FROM p WHERE score_a - score_b <> 0),
c AS (SELECT l_linestatus, abs(d) AS value, CAST(count(*) AS DOUBLE) AS n,
             CAST(count(*) FILTER (WHERE d > 0) AS DOUBLE) AS n_plus FROM d GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_linestatus ORDER BY value
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS mid FROM c),
s AS (SELECT l_linestatus, sum(n) AS nn, sum(mid * n_plus) AS wp, sum(mid * (n - n_plus)) AS wm,
             sum(n * n * n - n) AS tt FROM r GROUP BY ALL)
SELECT l_linestatus, CAST(nn AS BIGINT) AS n, round(wp, 4) AS w_plus, round(wm, 4) AS w_minus,
       round(least(wp, wm), 4) AS w_stat,
       round(abs(least(wp, wm) - nn * (nn + 1) / 4.0)
             / sqrt(nn * (nn + 1) * (2 * nn + 1) / 24.0 - tt / 48.0), 4) AS z
FROM s
"""


@register("wilcoxon", ORACLE_WILCOXON)
def q_wilcoxon(spark, sf_dir):
    """Wilcoxon signed-rank of two paired scores, per line status."""
    df = fixture(spark, sf_dir, _TWO_MODELS, "lineitem")
    return stats.wilcoxon_signed_rank(df, "l_linestatus", "score_a", "score_b")


# three formula scores per order: blocks = orders, treatments = formulas
_ORDER_SCORES = """
SELECT o_orderkey AS block, 'm1' AS model, round(o_totalprice / 1000.0, 0) AS score FROM orders
UNION ALL SELECT o_orderkey, 'm2', round(o_totalprice / 1500.0 + (o_custkey % 10), 0) FROM orders
UNION ALL SELECT o_orderkey, 'm3', round((o_custkey % 400) * 1.0, 0) FROM orders
"""

ORACLE_FRIEDMAN = f"""
WITH v AS ({_ORDER_SCORES}),
r AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY score)
                + (count(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS mid FROM v),
ties AS (SELECT block, score, count(*) AS t FROM r GROUP BY ALL),
tb AS (SELECT count(DISTINCT block) AS b, sum(t * t * t - t) AS tt FROM ties),
rs AS (SELECT model, sum(mid) AS rj FROM r GROUP BY ALL),
s AS (SELECT sum(rj * rj) AS srj, count(*) AS k FROM rs)
SELECT CAST(b AS BIGINT) AS blocks, CAST(k AS BIGINT) AS k,
       round((12.0 / (b * k * (k + 1)) * srj - 3.0 * b * (k + 1)) / (1 - tt / (b * k * (k * k - 1.0))), 4) AS q_stat,
       CAST(k - 1 AS BIGINT) AS dof
FROM s, tb
"""


@register("friedman", ORACLE_FRIEDMAN)
def q_friedman(spark, sf_dir):
    """Friedman test of three score formulas ranked within each order."""
    df = fixture(spark, sf_dir, _ORDER_SCORES, "orders")
    return stats.friedman(df, "block", "model", "score")
