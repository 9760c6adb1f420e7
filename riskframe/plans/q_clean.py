"""Registered profiling and cleaning queries (D-1..D-9, D-27, B-1..B-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import clean, profile
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.registry import fixture, register, views

DIRTY_COLS = [("o_orderkey", "bigint"), ("total", "double"), ("cust_mod", "double"),
              ("sparse_col", "double"), ("price_out", "double"), ("const_one", "double"),
              ("priority", "string"), ("status", "string")]
_NUM = {"bigint", "double"}

_DIRTY_CLEAN = f"""t AS (SELECT o_orderkey, total, CASE WHEN isnan(cust_mod) THEN NULL ELSE cust_mod END AS cust_mod,
       sparse_col, price_out, const_one, priority, status FROM ({fx.ORDERS_DIRTY}) d)"""


def _profile_branch(c: str, t: str) -> str:
    num = t in _NUM
    stats = (f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), round(avg({c}), 4), round(stddev_samp({c}), 4), "
             f"quantile_cont({c}, 0.25), quantile_cont({c}, 0.75)") if num else \
        "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), " \
        "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
    return (f"SELECT '{c}', '{t}', count({c}), count(*) - count({c}), "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2), count(DISTINCT {c}), {stats}, "
            + (f"list(CAST({c} AS DOUBLE) ORDER BY o_orderkey) FILTER (WHERE {c} IS NOT NULL)[1:5], "
               "CAST(NULL AS VARCHAR[]) FROM t" if num else
               f"CAST(NULL AS DOUBLE[]), list({c} ORDER BY o_orderkey) FILTER (WHERE {c} IS NOT NULL)[1:5] FROM t"))


ORACLE_PROFILE = (f"WITH {_DIRTY_CLEAN}, p(\"column\", dtype, non_null, null_count, null_pct, n_unique, min, max, "
                  "mean, std, q25, q75, sample_numbers, sample_values) AS (\n"
                  + "\nUNION ALL ".join(_profile_branch(c, t) for c, t in DIRTY_COLS)
                  + ")\nSELECT \"column\", dtype, CAST(non_null AS BIGINT) AS non_null, CAST(null_count AS BIGINT) AS null_count, "
                    "null_pct, CAST(n_unique AS BIGINT) AS n_unique, min, max, mean, std, q25, q75, sample_numbers, sample_values FROM p")


def _dirty(spark, sf_dir):
    return fixture(spark, sf_dir, fx.ORDERS_DIRTY, "orders")


@register("profile_columns", ORACLE_PROFILE)
def q_profile(spark, sf_dir):
    """Per-column profile of the dirty orders fixture, samples in order-key order."""
    return profile.profile_columns(_dirty(spark, sf_dir), key_cols=["o_orderkey"])


ORACLE_MISSING = (f"WITH {_DIRTY_CLEAN}, p(\"column\", num, rows, nulls) AS (\n"
                  + "\nUNION ALL ".join(f"SELECT '{c}', {str(t in _NUM).upper()}, count(*), count(*) - count({c}) FROM t"
                                        for c, t in DIRTY_COLS)
                  + ")\nSELECT \"column\", CAST(nulls AS BIGINT) AS null_count, round(nulls * 100.0 / rows, 2) AS null_pct, "
                    "CASE WHEN round(nulls * 100.0 / rows, 2) > 60 THEN 'DROPPED' WHEN num THEN 'IMPUTED_MEDIAN' "
                    "ELSE 'IMPUTED_MODE' END AS action FROM p WHERE nulls > 0")


@register("missing_summary", ORACLE_MISSING)
def q_missing(spark, sf_dir):
    """Columns with nulls in the dirty fixture and the cleaning action for each."""
    return profile.missing_summary(_dirty(spark, sf_dir))


ORACLE_NOTES = (f"WITH {_DIRTY_CLEAN}, p(\"column\", dtype, null_pct, n_unique) AS (\n"
                + "\nUNION ALL ".join(f"SELECT '{c}', '{t}', round((count(*) - count({c})) * 100.0 / count(*), 2), "
                                      f"count(DISTINCT {c}) FROM t" for c, t in DIRTY_COLS)
                + ")\nSELECT \"column\", dtype, null_pct, CAST(n_unique AS BIGINT) AS n_unique, "
                  "CASE WHEN null_pct > 20 THEN 'High missingness' WHEN null_pct > 5 THEN 'Moderate missingness' "
                  "ELSE '' END AS note FROM p")


@register("missingness_notes", ORACLE_NOTES)
def q_notes(spark, sf_dir):
    """Data-dictionary rows with missingness notes for the dirty fixture."""
    return profile.missingness_notes(profile.profile_columns(_dirty(spark, sf_dir)))


ORACLE_DROP_SPARSE = f"""WITH {_DIRTY_CLEAN}
SELECT o_orderkey, total, cust_mod, price_out, const_one, priority, status FROM t"""


@register("drop_sparse", ORACLE_DROP_SPARSE)
def q_drop_sparse(spark, sf_dir):
    """Dirty fixture without the columns that are more than 60 % null."""
    from riskframe.functions.columns import nan_to_null
    out, _ = clean.drop_sparse(nan_to_null(_dirty(spark, sf_dir)))
    return out


ORACLE_IMPUTE = f"""WITH {_DIRTY_CLEAN},
m AS (SELECT quantile_cont(total, 0.5) AS mt, quantile_cont(cust_mod, 0.5) AS mc FROM t),
pc AS (SELECT priority AS mp FROM t WHERE priority IS NOT NULL GROUP BY priority
       ORDER BY count(*) DESC, priority LIMIT 1)
SELECT o_orderkey, coalesce(total, mt) AS total, coalesce(cust_mod, mc) AS cust_mod, price_out, const_one,
       coalesce(priority, mp) AS priority, status
FROM t, m, pc"""


@register("impute", ORACLE_IMPUTE)
def q_impute(spark, sf_dir):
    """Median (numeric) / mode (text) imputation after dropping sparse columns."""
    from riskframe.functions.columns import nan_to_null
    df, _ = clean.drop_sparse(nan_to_null(_dirty(spark, sf_dir)))
    return clean.apply_impute(df, clean.impute_params(df))


ORACLE_DEDUPE = f"SELECT DISTINCT * FROM ({fx.LINEITEM_DUPES}) d"


@register("dedupe_exact", ORACLE_DEDUPE)
def q_dedupe(spark, sf_dir):
    """Exact duplicate removal over a projection of lineitem with natural duplicates."""
    return clean.dedupe_exact(fixture(spark, sf_dir, fx.LINEITEM_DUPES, "lineitem"))


OUTLIER_COLS = ["total", "cust_mod", "price_out", "const_one"]


def _outlier_branch(c: str) -> str:
    return f"""SELECT '{c}' AS "column",
  (SELECT count(*) FROM t, m_{c} WHERE sd > 0 AND abs(coalesce({c}, med) - mu) > 3 * sd) AS outliers,
  (SELECT quantile_cont({c}, 0.01) FROM t) AS lower, (SELECT quantile_cont({c}, 0.99) FROM t) AS upper"""


ORACLE_OUTLIERS = (f"WITH {_DIRTY_CLEAN},\n"
                   + ",\n".join(f"md_{c} AS (SELECT quantile_cont({c}, 0.5) AS med FROM t),\n"
                                f"m_{c} AS (SELECT med, avg(coalesce({c}, med)) AS mu, stddev_pop(coalesce({c}, med)) AS sd "
                                f"FROM t, md_{c} GROUP BY med)" for c in OUTLIER_COLS)
                   + "\n" + "\nUNION ALL ".join(_outlier_branch(c).replace("SELECT '", "SELECT '", 1)
                                               for c in OUTLIER_COLS))
ORACLE_OUTLIERS = ORACLE_OUTLIERS.replace("UNION ALL SELECT", "UNION ALL SELECT")
ORACLE_OUTLIERS = "SELECT \"column\", CAST(outliers AS BIGINT) AS outliers, lower, upper FROM (" + ORACLE_OUTLIERS + ") o"


@register("outlier_count", ORACLE_OUTLIERS)
def q_outliers(spark, sf_dir):
    """|z| > 3 counts (population sigma, median-filled) and p01/p99 bounds."""
    return clean.outlier_params(_dirty(spark, sf_dir), OUTLIER_COLS)


ORACLE_WINSORIZE = f"""WITH o AS ({ORACLE_OUTLIERS}), {_DIRTY_CLEAN}
SELECT o_orderkey,
  CASE WHEN (SELECT outliers FROM o WHERE "column" = 'total') > 0
       THEN least(greatest(total, (SELECT lower FROM o WHERE "column" = 'total')),
                  (SELECT upper FROM o WHERE "column" = 'total')) ELSE total END AS total,
  CASE WHEN (SELECT outliers FROM o WHERE "column" = 'cust_mod') > 0
       THEN least(greatest(cust_mod, (SELECT lower FROM o WHERE "column" = 'cust_mod')),
                  (SELECT upper FROM o WHERE "column" = 'cust_mod')) ELSE cust_mod END AS cust_mod,
  CASE WHEN (SELECT outliers FROM o WHERE "column" = 'price_out') > 0
       THEN least(greatest(price_out, (SELECT lower FROM o WHERE "column" = 'price_out')),
                  (SELECT upper FROM o WHERE "column" = 'price_out')) ELSE price_out END AS price_out,
  const_one
FROM t"""


@register("winsorize", ORACLE_WINSORIZE)
def q_winsorize(spark, sf_dir):
    """Clip columns that have |z| > 3 outliers to their exact p01 / p99."""
    from riskframe.functions.columns import nan_to_null
    df = nan_to_null(_dirty(spark, sf_dir)).select("o_orderkey", *OUTLIER_COLS)
    return clean.winsorize(df, clean.outlier_params(df, OUTLIER_COLS))


ORACLE_QUALITY = f"""WITH d AS ({fx.LINEITEM_DUPES}), u AS (SELECT DISTINCT * FROM d),
s AS (SELECT (SELECT count(*) FROM u) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM u) x) AS distinct_rows,
             (SELECT count(*) FROM d) AS orig,
             (SELECT (count(l_quantity) + count(l_discount) + count(l_tax) + count(l_returnflag)) FROM u) AS nn)
SELECT CAST(rows AS BIGINT) AS rows, CAST(distinct_rows AS BIGINT) AS distinct_rows,
       round(nn * 100.0 / (rows * 4.0), 4) AS completeness,
       round((1.0 - (rows - distinct_rows) / CAST(rows AS DOUBLE)) * 100.0, 4) AS uniqueness,
       round(rows * 100.0 / orig, 4) AS retention,
       round(nn * 100.0 / (rows * 4.0) * 0.5 + (1.0 - (rows - distinct_rows) / CAST(rows AS DOUBLE)) * 100.0 * 0.3
             + rows * 100.0 / orig * 0.2, 2) AS quality_score,
       CASE WHEN nn * 100.0 / (rows * 4.0) * 0.5 + (1.0 - (rows - distinct_rows) / CAST(rows AS DOUBLE)) * 30.0
                 + rows * 100.0 / orig * 0.2 >= 85 THEN 'PASS'
            WHEN nn * 100.0 / (rows * 4.0) * 0.5 + (1.0 - (rows - distinct_rows) / CAST(rows AS DOUBLE)) * 30.0
                 + rows * 100.0 / orig * 0.2 >= 70 THEN 'WARN' ELSE 'FAIL' END AS gate
FROM s"""


@register("quality_score", ORACLE_QUALITY)
def q_quality(spark, sf_dir):
    """Quality score of the de-duplicated projection against the original row count."""
    d = fixture(spark, sf_dir, fx.LINEITEM_DUPES, "lineitem")
    return clean.quality_score(clean.dedupe_exact(d), original_rows=d)


def _cats(spark, sf_dir):
    return fixture(spark, sf_dir, fx.ORDERS_CATEGORIES, "orders")


ORACLE_MAP_CATEGORIES = f"""WITH c AS ({fx.ORDERS_CATEGORIES})
SELECT o_orderkey,
  CASE lower(trim(education)) WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 WHEN 'higher' THEN 3 END AS education,
  CASE lower(trim(sex)) WHEN 'female' THEN 0 WHEN 'male' THEN 1 END AS sex,
  CASE lower(trim(areas)) WHEN 'rural' THEN 1 WHEN 'semiurban' THEN 2 WHEN 'urban' THEN 3 END AS areas
FROM c"""


@register("map_categories", ORACLE_MAP_CATEGORIES)
def q_map_categories(spark, sf_dir):
    """Dictionary encoding of education / sex / areas; unmapped values -> NULL."""
    return clean.map_categories(_cats(spark, sf_dir).select("o_orderkey", "education", "sex", "areas"))


ORACLE_YES_NO = f"""WITH c AS ({fx.ORDERS_CATEGORIES})
SELECT o_orderkey,
  CAST(CASE WHEN lower(trim(flag_yn)) IN ('yes', 'true') THEN 1 WHEN lower(trim(flag_yn)) IN ('no', 'false') THEN 0 END AS TINYINT) AS flag_yn,
  CAST(CASE WHEN lower(trim(flag_tf)) IN ('yes', 'true') THEN 1 WHEN lower(trim(flag_tf)) IN ('no', 'false') THEN 0 END AS TINYINT) AS flag_tf,
  o_orderpriority
FROM c"""


@register("encode_yes_no", ORACLE_YES_NO)
def q_yes_no(spark, sf_dir):
    """Detect two-valued yes/no and true/false text columns and encode them 1/0."""
    df = _cats(spark, sf_dir).select("o_orderkey", "flag_yn", "flag_tf", "o_orderpriority")
    cols = [r["column"] for r in clean.binary_text_columns(df).collect()]  # one row per column
    return clean.encode_yes_no(df, cols)


ORACLE_LABEL_ENCODE = """
WITH p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL) x),
s AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code
      FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL) x)
SELECT o_orderkey, CAST(p.code AS INTEGER) AS o_orderpriority, CAST(s.code AS INTEGER) AS o_orderstatus
FROM orders LEFT JOIN p ON orders.o_orderpriority = p.v LEFT JOIN s ON orders.o_orderstatus = s.v"""


@register("label_encode", ORACLE_LABEL_ENCODE)
def q_label_encode(spark, sf_dir):
    """Sorted-distinct integer codes for order priority and status."""
    views(spark, sf_dir, "orders")
    df = spark.table("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return clean.label_encode(df, ["o_orderpriority", "o_orderstatus"])


ORACLE_NORMALIZE = """SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd,
  o_orderstatus AS status, o_orderpriority AS status_2 FROM orders"""


@register("normalize_columns", ORACLE_NORMALIZE)
def q_normalize(spark, sf_dir):
    """Column-name normalisation, with a collision suffixed _2."""
    views(spark, sf_dir, "orders")
    df = spark.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return profile.normalize_columns(df.toDF("Order Key", " Total  Price (USD) ", "Status!", "STATUS"))


ORACLE_INFER_TARGET = """SELECT * FROM (VALUES ('orders_labelled', 'label'), ('orders_dirty', 'status'),
  ('lineitem_dupes', 'l_returnflag')) v(source, target)"""


@register("infer_target", ORACLE_INFER_TARGET)
def q_infer_target(spark, sf_dir):
    """Label-column inference over three fixtures (name rule, then fallbacks).

    orders_labelled has a column named ``label``; orders_dirty has no
    candidate name and falls back to the last column; lineitem_dupes falls
    back to its first column with at most two distinct values after the
    name rule fails (here: none, so the last column).
    """
    found = [profile.infer_target(fixture(spark, sf_dir, sql, tbl), fallback=fb).select(F.lit(name).alias("source"), "target")
             for name, sql, tbl, fb in [("orders_labelled", fx.ORDERS_LABELLED, "orders", "last"),
                                        ("orders_dirty", fx.ORDERS_DIRTY, "orders", "last"),
                                        ("lineitem_dupes", fx.LINEITEM_DUPES, "lineitem", "first_binary_else_last")]]
    return found[0].unionByName(found[1]).unionByName(found[2])
