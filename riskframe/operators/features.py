"""Feature preparation (B-9..B-11, B-19, D-10, D-11, D-19..D-21, M-5).

Fitted parameters (means, sigmas, medians, IQRs, category lists) are small
tables with one row per column (or per column value); they are collected or
broadcast, never the data.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import attach_scalars, dbl, numeric_columns, unpivot_numeric, unpivot_string
from riskframe.operators.profile import value_counts
from riskframe.operators.ranks import exact_quantiles, occurrence_number
from riskframe.session import written


def feature_diff(df: DataFrame, a: str = "ap_hi", b: str = "ap_lo", name: str = "pulse_pressure") -> DataFrame:
    """a - b when both columns exist (pulse pressure)."""
    if a in df.columns and b in df.columns:
        return df.withColumn(name, F.col(a) - F.col(b))
    return df


def feature_ratio(df: DataFrame, weight: str = "weight", height: str = "height", name: str = "bmi",
                  cm_if_mean_above: float = 10.0) -> DataFrame:
    """weight / height_m^2; height is read as centimetres when mean(height) > 10.

    The unit decision is a dataset-level aggregate attached as one broadcast row.
    """
    if weight not in df.columns or height not in df.columns:
        return df
    m = df.agg(F.avg(height).alias("__mh"))
    h = F.when(F.col("__mh") > cm_if_mean_above, dbl(height) / 100.0).otherwise(dbl(height))
    return attach_scalars(df, m).withColumn(name, F.try_divide(dbl(weight), h * h)).drop("__mh")


def feature_decade(df: DataFrame, age: str = "age", name: str = "age_decade") -> DataFrame:
    """floor(age / 10) as INT."""
    if age not in df.columns:
        return df
    return df.withColumn(name, F.floor(dbl(age) / 10.0).cast("int"))


def age_group(age) -> "F.Column":
    """'50s'-style anonymised age band."""
    a = F.col(age) if isinstance(age, str) else age
    return F.concat((F.floor(dbl(a) / 10.0) * 10).cast("int").cast("string"), F.lit("s"))


# fixed values: the two model schemas; a name maps to a constant or to what it is made from
SURVEY_MARKERS = ("sbp_avg", "dbp_avg", "sex")
SURVEY_GLUCOSE = {1: 95.0, 2: 125.0, 3: 180.0}
SURVEY_CONSTANTS = {"patient_id": 0.0, "education": 1.0, "marital_status": 1.0, "occupation": 1.0, "village": 1.0,
                    "areas": 1.0, "bplt": 0.0, "lltt": 0.0, "aptt": 0.0}
DAYS_PER_YEAR = 365.25


def feature_row(records: DataFrame, features: list[str], key: str, scaling: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(key, *features): input records mapped to a fitted model's feature columns.

    The survey schema is used if the features name one of its columns, else
    the vitals schema (age in days). Features that neither knows are 0.0.
    ``scaling`` (feature -> centre, scale) is applied as in training.
    """
    bmi = dbl("weight") / F.pow(dbl("height") / 100.0, 2)
    decade = F.floor(dbl("age") / 10.0).cast("double")
    pulse = dbl("ap_hi") - dbl("ap_lo")
    if any(f in SURVEY_MARKERS for f in features):
        glucose = F.when(F.col("gluc") == 1, SURVEY_GLUCOSE[1]).when(F.col("gluc") == 2, SURVEY_GLUCOSE[2]).otherwise(SURVEY_GLUCOSE[3])
        known = {"age": dbl("age"), "sex": F.when(F.col("gender") == 2, 1.0).otherwise(0.0), "sbp_avg": dbl("ap_hi"),
                 "dbp_avg": dbl("ap_lo"), "bg_mgdl": glucose, "bmi": bmi, "smoking": dbl("smoke"), "pulse_pressure": pulse,
                 "age_decade": decade} | {k: F.lit(v) for k, v in SURVEY_CONSTANTS.items()}
    else:
        same = ("gender", "height", "weight", "ap_hi", "ap_lo", "cholesterol", "gluc", "smoke", "alco", "active")
        known = {c: dbl(c) for c in same} | {"id": F.lit(0.0), "age": dbl("age") * DAYS_PER_YEAR, "pulse_pressure": pulse,
                                             "bmi": bmi, "age_decade": decade}
    out = []
    for f in features:
        value = known.get(f, F.lit(0.0))
        if scaling and f in scaling:
            value = (value - F.lit(scaling[f][0])) / F.lit(scaling[f][1])
        out.append(value.alias(f))
    return records.select(key, *out)


# fixed values: leak blocklist of the preparation step
LEAK_NAMES = ["cvdrisk", "patient_id"]
LEAK_SUBSTRINGS = ["risk_score", "risk_label", "risk_prob", "prediction"]


def leaky_columns(columns: list[str], target: str, names=LEAK_NAMES, substrings=LEAK_SUBSTRINGS) -> list[str]:
    """Exact blocklisted names and names containing a blocklisted part; never the target."""
    out = []
    for c in columns:
        if c == target:
            continue
        lc = c.lower()
        if c in names or lc in names or any(s in lc for s in substrings):
            out.append(c)
    return out


def drop_leaky(df: DataFrame, target: str, names=LEAK_NAMES, substrings=LEAK_SUBSTRINGS) -> DataFrame:
    return df.drop(*leaky_columns(df.columns, target, names, substrings))


def target_correlation(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """(feature, corr, abs_corr): Pearson r with the target over pairwise non-null rows.

    Built from population covariance and sigmas (stable streaming
    aggregates); a constant column gives NULL instead of an ANSI error.
    """
    features = features or numeric_columns(df, exclude=(target,))
    long = (unpivot_numeric(df.select(dbl(target).alias("__y"), *features), ["__y"], features)
            .where(F.col("value").isNotNull() & F.col("__y").isNotNull()))
    r = long.groupBy("feature").agg(
        F.try_divide(F.covar_pop("value", "__y"),
                     F.stddev_pop("value") * F.stddev_pop("__y")).alias("_r"))
    return r.select("feature", F.round("_r", 4).alias("corr"), F.round(F.abs("_r"), 4).alias("abs_corr"))


def correlation_ranking(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """``target_correlation`` with ``rank``: 1 for the smallest |r| (ties by name); features without a correlation come last."""
    ascending = Window.orderBy(F.col("abs_corr").asc_nulls_last(), "feature")  # one row per feature
    return target_correlation(df, target, features).withColumn("rank", F.row_number().over(ascending))


def leakage_audit(df: DataFrame, target: str, features: list[str] | None = None,
                  threshold: float = 0.90) -> DataFrame:
    """Features whose |r| with the target exceeds ``threshold`` (the run aborts on any)."""
    return (target_correlation(df, target, features)
            .withColumn("leak", F.col("abs_corr") > threshold))


def correlation_matrix(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Long-form Pearson matrix (f1, f2, corr) over pairwise complete rows, both triangles.

    One aggregation with k (k + 1) / 2 pair expressions; beyond ~100 columns
    use ``pyspark.ml.stat.Correlation`` instead (code-size limits).
    """
    aggs = []
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        a, b = dbl(columns[i]), dbl(columns[j])
        both = a.isNotNull() & b.isNotNull()
        x, y = F.when(both, a), F.when(both, b)
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"_{i}_{j}"))
    r = df.agg(*aggs)
    pairs = []
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        pairs.append(F.struct(F.lit(columns[i]).alias("f1"), F.lit(columns[j]).alias("f2"),
                              F.col(f"_{i}_{j}").alias("v")))
        if i != j:
            pairs.append(F.struct(F.lit(columns[j]).alias("f1"), F.lit(columns[i]).alias("f2"),
                                  F.col(f"_{i}_{j}").alias("v")))
    return (r.select(F.inline(F.array(*pairs)))
            .select("f1", "f2", F.round("v", digits).alias("corr")))


# fixed values: name parts that select robust scaling
ROBUST_PARTS = ["bp", "pressure", "chol", "glucose", "gluc", "bmi", "weight", "height"]


def robust_columns(columns: list[str], parts=ROBUST_PARTS) -> list[str]:
    return [c for c in columns if any(p in c.lower() for p in parts)]


def robust_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, center = exact median, scale = IQR, 0 -> 1)."""
    vc = value_counts(df, columns).where(F.col("dval").isNotNull()).select("column", "dval", "n")
    q = exact_quantiles(vc, ["column"], "dval", "n", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    iqr = F.col("q75") - F.col("q25")
    return q.select("column", F.col("q50").alias("center"),
                    F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def standard_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, center = mean, scale = population sigma, 0 -> 1)."""
    long = unpivot_numeric(df.select(*columns), [], columns).where(F.col("value").isNotNull())
    s = long.groupBy("feature").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("sd"))
    return s.select(F.col("feature").alias("column"), "center",
                    F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd")).alias("scale"))


def apply_scaling(df: DataFrame, params: DataFrame) -> DataFrame:
    """(x - center) / scale for every column in the params table (one row per column)."""
    p = {r["column"]: (r["center"], r["scale"]) for r in params.collect()}
    return df.select(*[((dbl(c) - F.lit(p[c][0])) / F.lit(p[c][1])).alias(c) if c in p else F.col(c)
                       for c in df.columns])


def one_hot_levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null levels per column.

    Levels become columns, so their number is bounded as in a pivot: more
    than ``spark.sql.pivotMaxValues`` in all raise ValueError.
    """
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = value_counts(df, columns).where(F.col("sval").isNotNull()).select("column", "sval").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} levels: use one_hot_sparse")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        levels[r["column"]].append(r["sval"])
    return {c: sorted(v) for c, v in levels.items()}


def one_hot(df: DataFrame, columns: list[str], levels: dict[str, list[str]] | None = None,
            drop_first: bool = True) -> DataFrame:
    """``col_value`` indicator columns (INT), sorted levels, first level dropped; NULL -> all 0.

    A column a level; ``one_hot_sparse`` takes any number of levels.
    """
    levels = levels or one_hot_levels(df, columns)
    out = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        lv = levels[c][1:] if drop_first else levels[c]
        out += [F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
                for v in lv]
    return df.select(*out)


def one_hot_sparse(df: DataFrame, key: str, columns: list[str], drop_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, levels) of a one-hot encoding of any width: ``rows`` are (key, indices), the
    ascending places of a row's ones; ``levels`` (column, value, index) names the places.

    Places run over the columns in the given order, their non-null values sorted,
    each column's first left out (with ``drop_first``). Levels are a table of
    their own, numbered in ranges and joined by value, so neither the driver nor a
    plan grows with them; a value that a third of all rows hold is split by
    Spark's skew join. A null has no one, and rows without any have an empty array.
    """
    place = {c: n for n, c in enumerate(columns)}
    long = unpivot_string(df, [key], columns, "column", "value").where(F.col("value").isNotNull())
    found = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = F.create_map(*[F.lit(x) for c, n in place.items() for x in (c, n)])
    if drop_first:
        lowest = found.groupBy("column").agg(F.min("value").alias("first"))  # a row a column
        found = found.join(F.broadcast(lowest), "column").where(F.col("value") != F.col("first"))
    ranked = found.select(F.lit(1).alias("one"), F.struct(F.element_at(order, F.col("column")).alias("c"), "value").alias("level"), "column", "value")
    levels = written(occurrence_number(ranked, ["one"], "level", "n").select("column", "value", (F.col("n") - 1).alias("index")), "levels")
    ones = long.join(levels, ["column", "value"]).groupBy(key).agg(F.array_sort(F.collect_list("index")).alias("indices"))
    rows = df.select(key).join(ones, key, "left")
    return rows.select(key, F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices")), levels
