"""Column profiling (D-1), missingness (D-3, D-27), target inference (B-1),
column-name normalisation (B-2) and dtype selection (B-3).

All per-column statistics come from one unpivoted, pre-aggregated table
``(column, sval, dval, n)``: one row per distinct value of each column. The
distinct count, mode, exact quantiles and moments are then cheap aggregates
over it, instead of one pass (or one Expand) per column.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from riskframe.functions.columns import nan_to_null, numeric_columns, sdiv
from riskframe.operators.ranks import exact_quantiles


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, sval STRING, dval DOUBLE, n) including a NULL row per column."""
    columns = columns or df.columns
    num = set(numeric_columns(df))
    items = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("sval"),
                 (F.col(c).cast("double") if c in num else F.lit(None).cast("double")).alias("dval"))
        for c in columns])
    return (df.select(F.inline(items))
            .groupBy("column", "sval", "dval").agg(F.count(F.lit(1)).alias("n")))


def _first_values_udf(n_keys: int, numeric: list[bool], k: int):
    """Per-partition top-k smallest row keys per column (non-null values only)."""
    def fn(it):
        keys = [f"_k{i}" for i in range(n_keys)]
        best: dict[int, pd.DataFrame] = {}
        for pdf in it:
            for i in range(len(numeric)):
                sub = pdf.loc[pdf[f"_v{i}"].notna(), [*keys, f"_v{i}"]].rename(columns={f"_v{i}": "_v"})
                if not sub.empty:
                    cand = pd.concat([best[i], sub]) if i in best else sub
                    best[i] = cand.sort_values(keys, kind="mergesort").head(k)
        for i, b in best.items():
            v = b["_v"].tolist()
            yield pd.DataFrame({"_i": i, "_d": v if numeric[i] else [None] * len(v), "_s": [None] * len(v) if numeric[i] else v,
                                **{c: b[c].tolist() for c in keys}}).astype({"_d": "float64"})
    return fn


def first_values(df: DataFrame, key_cols: list[str], columns: list[str], k: int = 5) -> DataFrame:
    """(column, sample_numbers, sample_values): the first ``k`` non-null values in
    key order, as doubles for numeric columns and as text for others.

    Each input partition keeps its own k smallest keys per column in one
    ``mapInPandas`` pass (no shuffle of the table); the global k are taken
    from at most k x partitions candidates per column.
    """
    num = numeric_columns(df)
    is_num = [c in num for c in columns]
    src = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)],
                    *[F.col(c).cast("double" if n else "string").alias(f"_v{i}") for i, (c, n) in enumerate(zip(columns, is_num))])
    schema = StructType([StructField("_i", IntegerType()), StructField("_d", DoubleType()), StructField("_s", StringType())]
                        + [StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(key_cols)])
    cand = src.mapInPandas(_first_values_udf(len(key_cols), is_num, k), schema)
    w = Window.partitionBy("_i").orderBy(*[F.col(f"_k{i}") for i in range(len(key_cols))])
    top = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_i") + 1)

    def values(of: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col(of).isNotNull(), F.struct("_r", of)))), lambda x: x[of])

    g = top.groupBy("_i").agg(values("_d").alias("_n"), values("_s").alias("_t"))
    return g.select(name.alias("column"), F.when(F.size("_n") > 0, F.col("_n")).alias("sample_numbers"),
                    F.when(F.size("_t") > 0, F.col("_t")).alias("sample_values"))


def null_shares(df: DataFrame) -> DataFrame:
    """(column, rows, null_count, null_pct) in one pass."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    r = nan_to_null(df).agg(*aggs)
    return (r.unpivot(["__rows"], df.columns, "column", "null_count")
            .select("column", F.col("__rows").alias("rows"), "null_count",
                    F.round(sdiv(F.col("null_count") * 100.0, "__rows"), 2).alias("null_pct")))


def profile_columns(df: DataFrame, key_cols: list[str] | None = None, samples: int = 5) -> DataFrame:
    """Per-column profile, one row per column.

    dtype, non_null, null_count, null_pct (2 dp), n_unique (nulls excluded),
    sample_numbers / sample_values (first ``samples`` non-null values in
    ``key_cols`` order, for numeric / other columns, when keys are given); numeric columns also min, max, mean (4 dp),
    std (sample, 4 dp), q25 and q75 (exact, linear interpolation). NaN counts
    as missing.
    """
    df = nan_to_null(df)
    cols = [c for c in df.columns]
    num = numeric_columns(df)
    dtypes = dict(df.dtypes)
    vc = value_counts(df, cols)
    nn = vc.where(F.col("sval").isNotNull())
    base = vc.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("sval").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.count_if(F.col("sval").isNotNull()).alias("n_unique"),
        F.min("dval").alias("min"), F.max("dval").alias("max"),
        F.try_divide(F.sum(F.col("dval") * F.col("n")),
                     F.sum(F.when(F.col("dval").isNotNull(), F.col("n")))).alias("_mean"))
    # centred second moment: second pass with the per-column mean (one row per column)
    ss = (nn.where(F.col("dval").isNotNull())
          .join(F.broadcast(base.select("column", "_mean")), "column")
          .groupBy("column").agg(F.sum(F.pow(F.col("dval") - F.col("_mean"), 2) * F.col("n")).alias("_ss")))
    qs = exact_quantiles(nn.where(F.col("dval").isNotNull()).select("column", "dval", "n"),
                         ["column"], "dval", "n", {"q25": 0.25, "q75": 0.75})
    dt = df.sparkSession.createDataFrame([(c, dtypes[c]) for c in cols], "column string, dtype string")
    out = (F.broadcast(dt).join(base, "column", "left").join(ss, "column", "left").join(qs, "column", "left")
           .select("column", "dtype",
                   F.col("non_null").cast("long").alias("non_null"),
                   (F.col("rows") - F.col("non_null")).cast("long").alias("null_count"),
                   F.round(F.try_divide((F.col("rows") - F.col("non_null")) * 100.0, F.col("rows")), 2).alias("null_pct"),
                   F.col("n_unique").cast("long").alias("n_unique"),
                   "min", "max",
                   F.round("_mean", 4).alias("mean"),
                   F.round(F.sqrt(F.try_divide(F.col("_ss"), F.col("non_null") - 1)), 4).alias("std"),
                   "q25", "q75"))
    if key_cols and samples:
        out = out.join(first_values(df, key_cols, cols, samples), "column", "left")
    return out


def missing_summary(df: DataFrame, drop_above_pct: float = 60.0) -> DataFrame:
    """Columns with nulls: null_count, null_pct and the cleaning action, from one aggregate.

    DROPPED above ``drop_above_pct`` (strict), IMPUTED_MEDIAN for numeric,
    IMPUTED_MODE otherwise; the fill values come from ``impute_params``.
    """
    return (null_shares(df).where(F.col("null_count") > 0)
            .select("column", "null_count", "null_pct",
                    F.when(F.col("null_pct") > drop_above_pct, "DROPPED")
                    .when(F.col("column").isin(*numeric_columns(df)), "IMPUTED_MEDIAN").otherwise("IMPUTED_MODE")
                    .alias("action")))


def missingness_notes(profile: DataFrame) -> DataFrame:
    """Data-dictionary rows: type, null %, distinct count and a missingness note."""
    # fixed values: note thresholds (> 20 % high, > 5 % moderate)
    return profile.select("column", "dtype", "null_pct", "n_unique",
                          F.when(F.col("null_pct") > 20, "High missingness")
                          .when(F.col("null_pct") > 5, "Moderate missingness").otherwise("").alias("note"))


def normalize_name(name: str) -> str:
    n = name.lower().strip()
    n = re.sub(r"\s+", "_", n)
    return re.sub(r"[^a-z0-9_]", "", n)


def normalize_columns(df: DataFrame) -> DataFrame:
    """lower -> strip -> whitespace runs to '_' -> drop [^a-z0-9_]; collisions get _2, _3."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = normalize_name(c)
        if n in seen:
            seen[n] += 1
            n2 = f"{n}_{seen[n]}"
            while n2 in seen:
                seen[n] += 1
                n2 = f"{n}_{seen[n]}"
            n = n2
        seen.setdefault(n, 1)
        out.append(n)
    return df.toDF(*out)


# fixed values: target-name candidates, in priority order
TARGET_CANDIDATES = ["target", "cvd", "cardio", "heart_disease", "cardiovascular",
                     "highrisk", "cvdrisk", "risk", "outcome", "label", "class", "diagnosis"]


def infer_target(df: DataFrame, override: str | None = None, fallback: str = "first_binary") -> DataFrame:
    """One row: ``target``, the label column of ``df`` (NULL if none is found).

    1. ``override`` if present; 2. the first column whose lower/stripped name
    without underscores equals a candidate (candidates normalised the same
    way, so ``heart_disease`` can match); 3. fallback: ``first_binary``
    (first column with <= 2 distinct values), ``last``, ``last_if_binary``,
    or ``first_binary_else_last``.
    """
    if fallback not in ("first_binary", "last", "last_if_binary", "first_binary_else_last"):
        raise ValueError(fallback)
    distinct = value_counts(df).groupBy("column").agg(F.count_if(F.col("sval").isNotNull()).alias("n_unique"))
    places = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "pos int, column string")  # the schema
    c = places.join(distinct, "column", "left").withColumn("binary", F.coalesce("n_unique", F.lit(0)) <= 2)
    names = [x.replace("_", "") for x in TARGET_CANDIDATES]
    named = F.replace(F.lower(F.trim("column")), F.lit("_"), F.lit("")).isin(names)
    first = lambda test: F.min_by("column", F.when(test, F.col("pos")))
    last = F.max_by("column", "pos")
    rule = {"first_binary": first(F.col("binary")), "last": last, "last_if_binary": F.when(F.max_by("binary", "pos"), last),
            "first_binary_else_last": F.coalesce(first(F.col("binary")), last)}[fallback]
    return c.agg(F.coalesce(first(F.col("column") == F.lit(override or "")), first(named), rule).alias("target"))


def select_dtypes(df: DataFrame, kind: str = "numeric", exclude=()) -> list[str]:
    """Column names by kind: ``numeric`` or ``other`` (booleans are not numeric)."""
    num = numeric_columns(df, exclude)
    if kind == "numeric":
        return num
    return [c for c in df.columns if c not in num and c not in exclude]
