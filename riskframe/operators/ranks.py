"""Running totals, mid-ranks and quantiles over ordered groups, without a global sort.

Mann-Whitney U, Kruskal-Wallis H, ROC-AUC and the Wilcoxon test need the
average rank of every value inside a group (a feature, a model, ...). A
window over the whole group would put it in one task, so:

1. the table is range-partitioned by (group, value) and written once to the
   shared checkpoint folder with each row's partition number, so a group of
   any size spreads over as many tasks as its rows need;
2. running totals are taken inside (partition, group);
3. the totals of a group's earlier partitions, one row per partition, are
   added.

Rows with null keys are a group like any other.

Where a value holds many rows the caller aggregates to one row per
``(group, value)`` with a count first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import join_keys
from riskframe.session import written

PART = "_range_part"


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned by ``order``, with its partition number, as a written table."""
    return written(df.repartitionByRange(*[F.col(c) for c in order]).withColumn(PART, F.spark_partition_id()), "ranged")


def cumulative_before(counts: DataFrame, keys: list[str], value: str, weight: str | dict[str, str] = "n",
                      out: str = "cum_before") -> DataFrame:
    """Add the total ``weight`` of the rows with a smaller ``value`` in the same group as ``out``.

    ``weight`` may map several output names to their weight columns, which
    are then taken in one pass. Values are distinct within a group.
    """
    weights = weight if isinstance(weight, dict) else {out: weight}
    c = ranged(counts, [*keys, value])
    totals = c.groupBy(*keys, PART).agg(*[F.sum(w).alias(f"_t_{o}") for o, w in weights.items()])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = totals.select(*keys, PART, *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}")
                                           for o in weights])
    inside = Window.partitionBy(PART, *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({f"_i_{o}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for o, w in weights.items()})
    c = join_keys(c, offsets, [*keys, PART]).withColumns({o: F.col(f"_o_{o}") + F.col(f"_i_{o}") for o in weights})
    return c.drop(PART, *[f"{p}_{o}" for o in weights for p in ("_o", "_i")])


def occurrence_number(df: DataFrame, keys: list[str], order: str, out: str = "occurrence") -> DataFrame:
    """Add each row's 1-based place in its group by ``order`` (unique within a group)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return (cumulative_before(one, keys, order, {"_before": "_one"})
            .withColumn(out, F.col("_before") + 1).drop("_before", "_one"))


def previous_value(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add ``value`` of the row before in the group (NULL for the first), carried over partition borders."""
    c = ranged(df, [*keys, order])
    inside = Window.partitionBy(PART, *keys).orderBy(order)
    c = c.withColumns({"_first": F.row_number().over(inside) == 1, "_lag": F.lag(value).over(inside)})
    last = c.groupBy(*keys, PART).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    border = last.select(*keys, PART, F.lag("_last").over(Window.partitionBy(*keys).orderBy(PART)).alias("_carried"))
    return (join_keys(c, border, [*keys, PART])
            .withColumn(out, F.when(F.col("_first"), F.col("_carried.v")).otherwise(F.col("_lag")))
            .drop("_first", "_lag", "_carried", PART))


def mid_ranks(counts: DataFrame, keys: list[str], value: str, weight: str = "n", out: str = "mid_rank") -> DataFrame:
    """Add ``out`` = average 1-based rank of ``value`` within ``keys``.

    ``counts`` has one row per (keys, value) and a non-negative ``weight``.
    Equal values share the mean of the ranks they span.
    """
    c = cumulative_before(counts, keys, value, weight, "_cb")
    return (c.withColumn(out, F.col("_cb").cast("double") + (F.col(weight).cast("double") + 1.0) / 2.0)
            .drop("_cb"))


def exact_quantiles(counts: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / quantile_cont rule).

    For N values in order, q sits at position h = q (N - 1) (0-based); the
    result is v[floor h] + (h - floor h) (v[ceil h] - v[floor h]). Works on
    the aggregated (keys, value, weight) table; returns one row per group.
    """
    c = cumulative_before(counts, keys, value, weight, "_cb")
    tot = c.groupBy(*keys).agg(F.sum(weight).alias("_N"))
    c = join_keys(c, tot, keys)
    lo_end = F.col("_cb")
    hi_end = F.col("_cb") + F.col(weight)
    aggs = []
    for name, q in qs.items():
        h = (F.col("_N") - 1).cast("double") * q
        lo = F.floor(h)
        hi = F.ceil(h)
        aggs.append(F.max(F.when((lo >= lo_end) & (lo < hi_end), F.col(value))).alias(f"_{name}_lo"))
        aggs.append(F.max(F.when((hi >= lo_end) & (hi < hi_end), F.col(value))).alias(f"_{name}_hi"))
        aggs.append(F.max(h - lo).alias(f"_{name}_f"))
    r = c.groupBy(*keys).agg(*aggs)
    outs = [(F.col(f"_{n}_lo") + F.col(f"_{n}_f") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
            for n in qs]
    return r.select(*keys, *outs)
