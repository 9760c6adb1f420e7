"""Exploratory aggregates (D-2, D-12..D-15, W-1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from riskframe.functions.columns import attach_scalars, dbl, unpivot_numeric
from riskframe.operators.ranks import exact_quantiles


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n, share 3 dp, minority_pct 2 dp)."""
    c = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("_t"), F.min("n").alias("_m"))
    return (attach_scalars(c, tot)
            .select("class", F.col("n").cast("long").alias("n"),
                    F.round(dbl("n") / F.col("_t"), 3).alias("share"),
                    F.round(dbl("_m") * 100.0 / F.col("_t"), 2).alias("minority_pct")))


def rate_by_group(df: DataFrame, group: str, target: str) -> DataFrame:
    """Positive rate per group in %, 1 dp (e.g. by age decade)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                 F.round(F.avg(dbl(target)) * 100.0, 1).alias("rate_pct"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (exact), max per column, 3 dp."""
    long = unpivot_numeric(df.select(*columns), [], columns).where(F.col("value").isNotNull())
    m = long.groupBy("feature").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                    F.max("value").alias("max"))
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(vc, ["feature"], "value", "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    j = m.join(q, "feature")
    return j.select("feature", F.col("count").cast("long"),
                    *[F.round(c, 3).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def histogram_by_class(df: DataFrame, target: str, features: list[str], bins: int = 20) -> DataFrame:
    """(feature, class, bin 1..bins, lo, hi, n) over all rows.

    Equal-width bins between each feature's min and max; the max falls in
    the last bin; a constant feature has one bin.
    """
    long = (unpivot_numeric(df.select(target, *features), [target], features)
            .where(F.col("value").isNotNull()).withColumnRenamed(target, "class"))
    rng = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width).cast("int") + 1, F.lit(bins)))
    # one row per feature: bounded by the feature count
    h = (long.join(F.broadcast(rng), "feature").withColumn("bin", b)
         .groupBy("feature", "class", "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")))
    return h.select("feature", "class", "bin",
                    F.round(F.col("_lo") + (F.col("bin") - 1) * width, 6).alias("lo"),
                    F.round(F.col("_lo") + F.col("bin") * width, 6).alias("hi"),
                    F.col("n").cast("long"))


def box_by_class(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, class, min, q1, median, q3, max) exact, per class."""
    long = (unpivot_numeric(df.select(target, *features), [target], features)
            .where(F.col("value").isNotNull()).withColumnRenamed(target, "class"))
    vc = long.groupBy("feature", "class", "value").agg(F.count(F.lit(1)).alias("n"))
    return exact_quantiles(vc, ["feature", "class"], "value", "n",
                           {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})


def _top_k_partition(groups: list[str], keys: list[str], k: int):
    def fn(it):
        best = None
        for pdf in it:
            cand = pdf if best is None else pd.concat([best, pdf])
            best = (cand.sort_values(groups + keys, kind="mergesort")
                    .groupby(groups, sort=False, dropna=False).head(k))
        if best is not None:
            yield best
    return fn


def first_n_per_group(df: DataFrame, groups: list[str], keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in key order, plus their 1-based ``pos``.

    Each partition first keeps its own first n per group (``mapInPandas``,
    no shuffle of the input); the window then ranks at most n x partitions
    candidates per group, so no task ever holds a whole group.
    """
    schema = StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields])
    cand = df.mapInPandas(_top_k_partition(groups, keys, n), schema)
    w = Window.partitionBy(*groups).orderBy(*keys)
    return cand.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def sample_per_class(df: DataFrame, target: str, value: str, key: list[str], n: int = 2000) -> DataFrame:
    """First ``n`` non-null values of ``value`` per class in key order."""
    base = df.select(F.col(target).alias("class"), *key, value).where(F.col(value).isNotNull())
    return first_n_per_group(base, ["class"], key, n)
