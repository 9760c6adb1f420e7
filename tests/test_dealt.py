from collections import Counter

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from riskframe.operators import explain, train
from riskframe.plans import q_explain
from riskframe.session import dealt


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_rows_are_dealt_by_their_number(spark):
    rows = [(n % 7, None if n % 3 else "x") for n in range(1000)]
    one = spark.createDataFrame(rows, "a int, b string").coalesce(1)
    got = dealt(one, rows_per_task=100)
    assert len(sizes(got)) == 10 and max(sizes(got)) <= 110
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    assert got.rdd.getNumPartitions() == 10
    assert dealt(one.limit(0)).collect() == []
    assert len(sizes(dealt(one))) == spark.sparkContext.defaultParallelism


def customers(spark, folder):
    rows = [(n, f"c{n}", n % 25, n * 10.0, "BUILDING") for n in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string") \
        .coalesce(1).write.parquet(f"{folder}/customer.parquet")


def test_tree_attributions_fits_on_rows_of_every_task(spark, tmp_path, monkeypatch):
    customers(spark, tmp_path)
    seen = []

    class Watched(GBTClassifier):
        def fit(self, data, params=None):
            seen.append(max(sizes(data)))
            return super().fit(data, params)

    monkeypatch.setattr(train, "_models", lambda rows, seed=42: [("GradientBoosting", Watched(maxIter=1, maxDepth=2, seed=seed))])
    monkeypatch.setattr(explain, "tree_attributions", lambda df, *rest: seen.append(max(sizes(df))) or df)
    assert q_explain.q_tree_attributions(spark, str(tmp_path)).count() == 400
    assert max(seen) <= 110  # of 400 rows in one file, with four cores
