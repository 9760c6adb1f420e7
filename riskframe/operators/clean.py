"""Cleaning operators (D-4..D-9, B-4..B-8).

Fitting steps (medians, modes, percentiles, category lists) are aggregations
that produce a small *params table*: one row per column, or one row per
(column, category). Applying them is a projection; the params are either
inlined as literals (one value per column) or broadcast (bounded lists).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import dbl, nan_to_null, numeric_columns, sdiv, unpivot_numeric
from riskframe.operators.profile import null_shares, value_counts
from riskframe.operators.ranks import cumulative_before, exact_quantiles


# ---------------------------------------------------------------- missing values

def drop_sparse(df: DataFrame, threshold_pct: float = 60.0) -> tuple[DataFrame, list[str]]:
    """Drop columns whose null share is strictly above ``threshold_pct``."""
    shares = null_shares(df).where(F.col("null_count") * 100.0 > F.col("rows") * threshold_pct)
    dropped = [r["column"] for r in shares.select("column").collect()]  # one row per column
    return df.drop(*dropped), dropped


def impute_params(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, fill) for columns with nulls: exact median for numeric
    columns, mode for the rest (ties -> smallest value)."""
    df = nan_to_null(df)
    columns = columns or df.columns
    num = set(numeric_columns(df))
    vc = value_counts(df, columns).where(F.col("sval").isNotNull())
    has_null = null_shares(df.select(*columns)).where(F.col("null_count") > 0).select("column")
    med = (exact_quantiles(vc.where(F.col("column").isin(*[c for c in columns if c in num]))
                           .select("column", "dval", "n"), ["column"], "dval", "n", {"median": 0.5})
           .select("column", F.lit("median").alias("kind"), F.col("median").cast("string").alias("fill")))
    mode = (vc.where(F.col("column").isin(*[c for c in columns if c not in num]))
            .groupBy("column").agg(F.min_by("sval", F.struct(-F.col("n"), F.col("sval"))).alias("fill"))
            .select("column", F.lit("mode").alias("kind"), "fill"))
    return med.unionByName(mode).join(has_null, "column", "left_semi")


def apply_impute(df: DataFrame, params: DataFrame) -> DataFrame:
    """coalesce(column, fill); the params table has one row per column."""
    fills = {r["column"]: r["fill"] for r in params.collect()}  # bounded by column count
    types = dict(df.dtypes)
    df = nan_to_null(df)
    return df.select(*[
        F.coalesce(F.col(c), F.lit(fills[c]).cast(types[c])).alias(c) if c in fills and fills[c] is not None
        else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- duplicates

def dedupe_exact(df: DataFrame) -> DataFrame:
    """Remove exact duplicate rows over all columns (NULL equals NULL)."""
    return df.dropDuplicates()


def dedupe_report(df: DataFrame) -> DataFrame:
    """before / after / removed row counts of ``dedupe_exact``, as one row."""
    before = df.agg(F.count(F.lit(1)).alias("before"))
    after = dedupe_exact(df).agg(F.count(F.lit(1)).alias("after"))
    return (before.join(after, how="cross")
            .select(F.col("before").cast("long"), F.col("after").cast("long"),
                    (F.col("before") - F.col("after")).cast("long").alias("removed")))


# ---------------------------------------------------------------- outliers

def outlier_params(df: DataFrame, columns: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """(column, outliers, lower, upper): count of |z| > ``z`` (population sigma,
    after median fill) and the exact p01 / p99 clip bounds. Constant columns
    have no outliers."""
    df = nan_to_null(df)
    columns = columns or numeric_columns(df)
    moments = df.agg(F.count(F.lit(1)).alias("_N"), *[F.struct(
        F.count(c).alias("nn"), F.avg(dbl(c)).alias("m"), F.var_pop(dbl(c)).alias("v")).alias(c) for c in columns])
    per = moments.select("_N", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.nn").alias("nn"),
                                                           F.col(f"`{c}`.m").alias("m"), F.col(f"`{c}`.v").alias("v"))
                                                  for c in columns])))
    vc = value_counts(df, columns).where(F.col("sval").isNotNull()).select("column", "dval", "n")
    qs = exact_quantiles(vc, ["column"], "dval", "n", {"median": 0.5, "lower": 0.01, "upper": 0.99})
    nulls = F.col("_N") - F.col("nn")
    m = per.join(qs, "column").withColumn("mean", (F.col("m") * F.col("nn") + F.col("median") * nulls) / F.col("_N"))
    m = m.withColumn("sd", F.sqrt((F.col("v") * F.col("nn") + F.col("nn") * F.pow(F.col("m") - F.col("mean"), 2)
                                   + nulls * F.pow(F.col("median") - F.col("mean"), 2)) / F.col("_N")))

    def far(x):
        return (F.col("sd") > 0) & (F.abs(x - F.col("mean")) > z * F.col("sd"))

    # One counting pass over the rows; the parameters are one row per column.
    long = unpivot_numeric(df.select(*columns), [], columns, "column", "value").where(F.col("value").isNotNull())
    cnt = long.join(m.select("column", "mean", "sd"), "column").groupBy("column").agg(F.count_if(far(F.col("value"))).alias("o"))
    o_null = F.when(far(F.col("median")), nulls).otherwise(0)
    return m.join(cnt, "column").select("column", (F.col("o") + o_null).cast("long").alias("outliers"), "lower", "upper")


def winsorize(df: DataFrame, params: DataFrame, exclude=()) -> DataFrame:
    """Clip every column with outliers to [p01, p99] (the whole column)."""
    p = {r["column"]: (r["lower"], r["upper"]) for r in params.where(F.col("outliers") > 0).collect()
         if r["column"] not in exclude}  # one row per column
    return df.select(*[
        F.least(F.greatest(F.col(c), F.lit(p[c][0])), F.lit(p[c][1])).alias(c) if c in p else F.col(c)
        for c in df.columns])


# ---------------------------------------------------------------- quality

def quality_score(df: DataFrame, original_rows: int | DataFrame | None = None) -> DataFrame:
    """0.5 completeness + 0.3 uniqueness + 0.2 retention (each in %), 2 dp.

    completeness = mean over columns of the non-null share; uniqueness =
    1 - (rows - distinct rows) / rows; retention = rows / original rows. An
    empty table has no scores and fails the gate.
    """
    cols = df.columns
    clean = nan_to_null(df)
    a = clean.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)])
    distinct = clean.dropDuplicates().agg(F.count(F.lit(1)).alias("distinct_rows"))
    s = a.join(distinct, how="cross")
    if isinstance(original_rows, DataFrame):
        s = s.join(original_rows.agg(F.count(F.lit(1)).alias("orig")), how="cross")
    else:
        s = s.withColumn("orig", F.col("rows") if original_rows is None else F.lit(original_rows))
    comp = sum((F.col(f"_nn{i}") for i in range(len(cols))), F.lit(0))
    comp = sdiv(comp, F.col("rows") * float(len(cols))) * 100.0
    uniq = (1.0 - sdiv(F.col("rows") - F.col("distinct_rows"), "rows")) * 100.0
    ret = sdiv("rows", "orig") * 100.0
    score = comp * 0.5 + uniq * 0.3 + ret * 0.2
    return s.select(F.col("rows").cast("long"), F.col("distinct_rows").cast("long"),
                    F.round(comp, 4).alias("completeness"), F.round(uniq, 4).alias("uniqueness"),
                    F.round(ret, 4).alias("retention"), F.round(score, 2).alias("quality_score"),
                    F.when(score >= 85, "PASS").when(score >= 70, "WARN").otherwise("FAIL").alias("gate"))


# ---------------------------------------------------------------- type fixes

# fixed values: category codes of the reference's cleaning step
CATEGORY_MAPS = {
    "sex": {"female": 0, "male": 1},
    "smoking": {"nonsmoker": 0, "smoker": 1},
    "highrisk": {"no": 0, "yes": 1},
    "bplt": {"no": 0, "yes": 1},
    "lltt": {"no": 0, "yes": 1},
    "aptt": {"no": 0, "yes": 1},
    "education": {"primary": 1, "secondary": 2, "higher": 3},
    "marital_status": {"single": 0, "married": 1, "divorced": 2, "widowed": 3},
    "occupation": {"not working": 0, "self-employed": 1, "casual worker": 2, "private worker": 3,
                   "government worker": 4},
    "areas": {"rural": 1, "semiurban": 2, "urban": 3},
}


def map_categories(df: DataFrame, maps: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """lower(trim(value)) looked up in a per-column map; unmapped values become NULL."""
    maps = CATEGORY_MAPS if maps is None else maps
    out = []
    for c in df.columns:
        key = c.lower().strip()
        if key in maps:
            m = F.create_map(*[x for k, v in maps[key].items() for x in (F.lit(k), F.lit(v))])
            out.append(F.try_element_at(m, F.lower(F.trim(F.col(c).cast("string")))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def encode_yes_no(df: DataFrame, columns: list[str]) -> DataFrame:
    """yes/true -> 1, no/false -> 0 for the given two-valued string columns.

    Callers pass the columns whose distinct lowered values are a subset of
    {yes, no} or {true, false} (see ``binary_text_columns``).
    """
    def enc(c):
        v = F.lower(F.trim(F.col(c)))
        return (F.when(v.isin("yes", "true"), F.lit(1)).when(v.isin("no", "false"), F.lit(0))
                .cast("tinyint").alias(c))
    return df.select(*[enc(c) if c in columns else F.col(c) for c in df.columns])


def binary_text_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind) for string columns with <= 2 distinct values that are yes/no or true/false."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    vc = value_counts(df, columns).where(F.col("sval").isNotNull())
    lv = F.lower(F.trim(F.col("sval")))
    return (vc.groupBy("column").agg(F.count(F.lit(1)).alias("k"),
                                     F.bool_and(lv.isin("yes", "no")).alias("yn"),
                                     F.bool_and(lv.isin("true", "false")).alias("tf"))
            .where((F.col("k") <= 2) & (F.col("yn") | F.col("tf")))
            .select("column", F.when(F.col("yn"), "yes/no").otherwise("true/false").alias("kind")))


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): 0-based index in the sorted distinct strings."""
    vc = value_counts(df, columns).where(F.col("sval").isNotNull()).select("column", "sval").distinct()
    one = vc.withColumn("_one", F.lit(1).cast("long"))
    return cumulative_before(one, ["column"], "sval", "_one", "_code").select(
        "column", F.col("sval").alias("value"), F.col("_code").cast("int").alias("code"))


def label_encode(df: DataFrame, columns: list[str], codes: DataFrame | None = None) -> DataFrame:
    """Replace each string column by its sorted-distinct code (NULL stays NULL).

    The code table is joined per column; Spark picks the join from its size.
    """
    codes = codes if codes is not None else label_codes(df, columns)
    out = df
    for c in columns:
        cc = (codes.where(F.col("column") == c)
              .select(F.col("value").alias(f"__v_{c}"), F.col("code").cast("int").alias(f"__c_{c}")))
        out = (out.join(cc, out[c].cast("string") == cc[f"__v_{c}"], "left")
               .drop(f"__v_{c}", c).withColumnRenamed(f"__c_{c}", c))
    return out.select(*df.columns)


def binary_cast(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """(df with two-valued columns as TINYINT, the columns left as they are
    because a value would not survive the cast)."""
    lost = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("tinyint").isNull()).alias(c)
                    for c in columns]).first()  # one row
    kept = [c for c in columns if lost[c]]
    return df.select(*[F.col(c).cast("string").try_cast("tinyint").alias(c) if c in columns and c not in kept else F.col(c)
                       for c in df.columns]), kept


def coerce_age(df: DataFrame, token: str = "age") -> DataFrame:
    """String columns whose name has ``token`` as a whole word part -> DOUBLE (bad -> NULL)."""
    import re
    hit = [c for c, t in df.dtypes if t == "string" and re.search(rf"(^|_){token}($|_)", c)]
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in hit else F.col(c) for c in df.columns])
