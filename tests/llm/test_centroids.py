import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from riskframe.llm import centroids

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("cluster", T.StringType()), T.StructField("v", T.StringType())])


def brute(rows, dimensions, clusters, rounds, scale=1024, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [centroids.scaled(x, scale) for x in v], v))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    cs = [r[1] for r in first[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        members = [[v for _, v, _ in kept if near(v)[1] == n] for n in range(len(cs))]
        cs = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, cs, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v, _ in kept]
    return out, cs


def rows_of(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = centroids.clustered_vectors(df, **kw).collect()
    return sorted([tuple(r) for r in got], key=str)


def expected(rows, **kw):
    out, cs = brute(rows, **kw)
    fits = lambda d: d if d < 1 << 63 else None
    total = [sum(d for _, k, d in out if k == c) if all(fits(d) is not None for _, k, d in out if k == c) else None
             for c in range(len(cs))]
    whole = sum(d for *_, d in out) if all(fits(d) is not None for *_, d in out) else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted([(i, c, fits(d), total[c] if total[c] is None else fits(total[c]), whole if whole is None else fits(whole), sha[c])
                   for i, c, d in out], key=str)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(n, [n % 3 / 4, -n / 8]) for n in range(20)] + [(4, [1.0, -0.5])] * 3 + [(None, [0.25, 0.5]), (None, [0.25, 0.25])]
    rows += [(50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [nan, 1.0]), (55, [inf, 1.0]), (56, [1.0, 2.0, 3.0])]
    kw = {"dimensions": 2, "clusters": 4, "rounds": 5}
    assert rows_of(spark, rows, **kw) == expected(rows, **kw)


def test_huge_components_are_exact(spark):
    rows = [(n, [(-1.0) ** n * 10.0 ** n, n + 0.3]) for n in range(24)] + [(90, [1.7e308, -1.7e308]), (91, [-1.7e308, 5.0])]
    kw = {"dimensions": 2, "clusters": 5, "rounds": 4}
    assert rows_of(spark, rows, **kw) == expected(rows, **kw)


def test_fewer_vectors_than_centroids_and_none(spark):
    kw = {"dimensions": 2, "clusters": 8, "rounds": 2}
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert rows_of(spark, rows, **kw) == expected(rows, **kw)
    assert rows_of(spark, [], **kw) == []
    assert rows_of(spark, [(1, None)], **kw) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=7),
       st.lists(st.integers(-5, 5), min_size=2, max_size=2))
def test_tournament_finds_the_smallest_nearest(cs, x):
    import numpy as np
    winner, far = centroids.Bisectors(cs, 2).assign(np.array([x], np.int64))
    best = min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cs))
    assert (int(far[0]), int(winner[0])) == best


@pytest.mark.parametrize("total", [0, 1, -1, 1 << 40, -(1 << 40), (1 << 200) - 7, -(1 << 200) + 9])
def test_limbs_add_up(total):
    assert sum(v << (40 * n) for n, v in centroids.limbs(total)) == total
