import math
import random

import pytest
from riskframe.operators import neighbours as nb


def brute(queries, points, k, exclude_self=False):
    out = []
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    for key, v in queries:
        if key is None or not ok(v):
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), p) for p, w in points
                      if p is not None and ok(w) and not (exclude_self and p == key))[:k]
        out += [(key, n, p, round(math.sqrt(d), 9)) for n, (d, p) in enumerate(near, start=1)]
    return sorted(out)


def found(spark, queries, points, k, **kw):
    q = spark.createDataFrame(queries, "id long, v array<double>").repartition(3)
    p = spark.createDataFrame(points, "id long, v array<double>").repartition(3)
    got = nb.nearest_neighbours(q, p, "id", "v", k, **kw)
    rows = got.found.join(got.queries.select("query", "id"), "query").collect()
    return sorted((r["id"], r["rank"], r["neighbour"], round(r["distance"], 9)) for r in rows), got


@pytest.mark.parametrize("exclude_self", [False, True])
def test_skewed_cells_ties_and_odd_rows(spark, exclude_self):
    rng = random.Random(11)
    rows = [(n, [float(rng.randrange(6)), float(rng.randrange(6)), rng.choice([0.0, 100.0])]) for n in range(700)]
    rows += [(1000 + n, [2.0, 3.0, 0.0]) for n in range(400)]  # a third of all rows are one vector
    rows += [(2000, [None, 1.0, 1.0]), (2001, [math.nan, 0.0, 0.0]), (2002, None), (None, [1.0, 1.0, 1.0]), (2003, [math.inf, 0.0, 0.0])]
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0] + [(3000, [50.0, 50.0, 50.0])]
    got, result = found(spark, queries, rows, 5, exclude_self=exclude_self, pivots=9, segment_bits=5, query_rows=7)
    assert got == brute(queries, rows, 5, exclude_self)
    compared = sum(r["compared"] for r in result.compared.collect())
    assert 0 < compared < 0.5 * len(queries) * 500  # of about 500 different vectors and copies that count


def test_fewer_points_than_neighbours_and_none(spark):
    rows = [(1, [0.0]), (2, [1.0]), (3, [1.0])]
    assert found(spark, rows, rows, 7)[0] == brute(rows, rows, 7)
    assert found(spark, rows, rows, 7, exclude_self=True)[0] == brute(rows, rows, 7, True)
    assert found(spark, rows, [(1, None)], 3)[0] == []
    assert found(spark, [], rows, 3)[0] == []


def test_far_clusters_are_not_visited(spark):
    rng = random.Random(2)
    rows = [(100 * c + n, [1000.0 * c + rng.random(), rng.random()]) for c in range(10) for n in range(100)]
    queries = rows[::10]
    got, result = found(spark, queries, rows, 3, pivots=30, segment_bits=4)
    assert got == brute(queries, rows, 3)
    assert max(r["compared"] for r in result.compared.collect()) <= 100


def test_vote_breaks_ties_by_the_smaller_label(spark):
    train = spark.createDataFrame([(1, 0.0, 2), (2, 1.0, 1), (3, 50.0, 1), (4, 51.0, 1), (5, 0.5, None)], "id long, x double, y int")
    test = spark.createDataFrame([(9, 0.5, 1), (8, 52.0, 1), (7, None, 2)], "id long, x double, y int")
    got = {r["id"]: (r["prob"], r["pred"]) for r in nb.knn_vote(train, test, "id", ["x"], "y", k=2).collect()}
    assert got == {9: (0.5, 1), 8: (1.0, 1), 7: (None, None)}


def test_oversampling_fills_up_every_class(spark):
    rng = random.Random(4)
    rows = [(n, float(rng.randrange(50)), float(rng.randrange(50)), 0) for n in range(60)]
    rows += [(100 + n, float(rng.randrange(9)), float(rng.randrange(9)), 1) for n in range(13)] + [(200, 5.0, 5.0, 2)]
    rows += [(300, None, 1.0, 1), (301, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(3)
    made = nb.oversample(df, "y", "id", ["a", "b"], k=3).collect()
    count = lambda y: sum(r["y"] == y for r in made)
    assert (count(0), count(1), count(2)) == (60, 60, 60) and len(made) == 181
    at = {r[0]: r[1:3] for r in rows}
    minority = [(i, list(v)) for i, *v, y in rows if y == 1 and v[0] is not None]
    near = {}
    for key, _, p, _ in brute(minority, minority, 3, True):
        near.setdefault(key, []).append(p)
    for r in made:
        if r["copy"] is not None:
            for c, x, z in zip("ab", at[r["base"]], at[r["neighbour"]], strict=True):
                assert abs(r[c] - (x + r["gap"] * (z - x))) < 1e-9 and 0 <= r["gap"] < 1
            assert r["neighbour"] in near.get(r["base"], [r["base"]])
    assert sorted(map(str, made)) == sorted(map(str, nb.oversample(df.repartition(2), "y", "id", ["a", "b"], k=3).collect()))
    balanced = df.where("y < 2 AND id < 120").limit(1000)
    assert nb.oversample(balanced.where("id < 15 OR id >= 100"), "y", "id", ["a", "b"]).where("copy IS NOT NULL").count() == 0
