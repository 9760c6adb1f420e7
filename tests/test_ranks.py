"""Range-partitioned running totals where one key holds nine tenths of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import alerts, ranks


@pytest.fixture
def spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_and_quantiles(spark, spread):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("abc"), i * 0.5, rng.randrange(1, 5), rng.randrange(3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, n long, m long")
    got = {(r["g"], r["v"]): (r["x"], r["y"]) for r in ranks.cumulative_before(df, ["g"], "v", {"x": "n", "y": "m"}).collect()}
    total = {}
    for g, v, n, m in rows:
        assert got[g, v] == total.get(g, (0, 0))
        total[g] = (total.get(g, (0, 0))[0] + n, total.get(g, (0, 0))[1] + m)
    q = {r["g"]: r["q"] for r in ranks.exact_quantiles(df, ["g"], "v", "n", {"q": 0.3}).collect()}
    for g in total:
        flat = [v for h, v, n, _ in rows if h == g for _ in range(n)]
        h = 0.3 * (len(flat) - 1)
        lo, hi = flat[int(h)], flat[min(int(h) + 1, len(flat) - 1)]
        assert abs(q[g] - (lo + (h - int(h)) * (hi - lo))) < 1e-9


def test_previous_value_crosses_partitions(spark, spread):
    df = spark.range(500).select(F.lit("k").alias("k"), F.col("id"), F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("v"))
    got = {r["id"]: r["p"] for r in ranks.previous_value(df, ["k"], "id", "v", "p").collect()}
    assert got == {i: None if i == 0 or (i - 1) % 5 == 0 else (i - 1) * 2 for i in range(500)}


def test_alert_counts_of_a_hot_key(spark, spread):
    ev = spark.range(400).select("id", F.when(F.col("id") % 10 > 0, "MEDIUM").otherwise("HIGH").alias("s"), F.lit("t").alias("t"))
    got = {r["id"]: (r["occurrence"], r["alert_triggered"]) for r in alerts.alert_threshold(ev, "s", "t", "id").collect()}
    seen = {}
    for i in range(400):
        s = "MEDIUM" if i % 10 else "HIGH"
        seen[s] = seen.get(s, 0) + 1
        assert got[i] == (seen[s], seen[s] >= {"HIGH": 3, "MEDIUM": 10}[s])
