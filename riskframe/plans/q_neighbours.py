"""Registered neighbour queries (M-2, M-11): exact search, the k-NN vote and minority oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import neighbours, train
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.q_train import FEATURES
from riskframe.plans.registry import fixture, register
from riskframe.sources.tables import table

_SQUARE = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

ORACLE_SEARCH = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT q.vec_id, p.vec_id AS neighbour, {_SQUARE.format(a="q.v", b="p.v")} AS s
      FROM e q JOIN e p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, neighbour) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(sqrt(s), 6) AS distance FROM r WHERE rank <= 10"""


@register("knn_search", ORACLE_SEARCH)
def q_search(spark, sf_dir):
    """The ten nearest other vectors of every vector whose id is divisible by 100, among all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    got = neighbours.nearest_neighbours(e.where(F.col("vec_id") % 100 == 0), e, "vec_id", "embedding", 10, exclude_self=True)
    return got.found.join(got.queries.select("query", "vec_id"), "query").select(
        "vec_id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


# Pressure, age and cholesterol decide the label, so that neighbours tell something.
LABELLED = f"SELECT *, CASE WHEN ap_hi + age + cholesterol * 10 > 190 THEN 1 ELSE 0 END AS risk FROM ({fx.VITALS}) v"
# A label of about one row in six.
RARE = f"SELECT *, CASE WHEN c_acctbal > 8000 THEN 1 ELSE 0 END AS rare FROM ({fx.VITALS}) v"


def _split_sql(rows: str, label: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY substr(sha256(CAST(patient_id AS VARCHAR) || '|42'), 1, 15)) - 1 "
            f"< round(count(*) OVER (PARTITION BY {label}) * 0.2) AS is_test FROM ({rows}) x")


_VECTOR = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURES) + "]"

ORACLE_VOTE = f"""WITH s AS (SELECT patient_id, risk, is_test, {_VECTOR} AS v FROM ({_split_sql(LABELLED, "risk")}) x),
d AS (SELECT t.patient_id, t.risk, p.risk AS vote, row_number() OVER (PARTITION BY t.patient_id ORDER BY {_SQUARE.format(a="t.v", b="p.v")}, p.patient_id) AS rank
      FROM s t JOIN s p ON t.is_test AND NOT p.is_test)
SELECT patient_id, any_value(risk) AS risk, round(avg(vote), 6) AS prob, CASE WHEN 2 * sum(vote) > 7 THEN 1 ELSE 0 END AS pred
FROM d WHERE rank <= 7 GROUP BY patient_id"""


@register("knn_vote", ORACLE_VOTE)
def q_vote(spark, sf_dir):
    """Every test row's vote of its seven nearest training rows."""
    s = train.stratified_split(fixture(spark, sf_dir, LABELLED, "customer"), "risk", "patient_id").select(
        "patient_id", "risk", "is_test", *FEATURES)
    voted = neighbours.knn_vote(s.where("NOT is_test"), s.where("is_test"), "patient_id", FEATURES, "risk")
    return voted.select("patient_id", "risk", F.round("prob", 6).alias("prob"), "pred")


_ADDED = ", ".join(f"round(v[{n}] + gap * (w[{n}] - v[{n}]), 6) AS {c}" for n, c in enumerate(FEATURES, start=1))

ORACLE_OVERSAMPLE = f"""WITH s AS (SELECT patient_id AS id, rare, {_VECTOR} AS v FROM ({_split_sql(RARE, "rare")}) x WHERE NOT is_test),
m AS (SELECT id, v, row_number() OVER (ORDER BY sha256(CAST(id AS VARCHAR) || '|42') || '|' || CAST(id AS VARCHAR)) AS turn, count(*) OVER () AS n,
             (SELECT count(*) FILTER (WHERE rare = 0) - count(*) FILTER (WHERE rare = 1) FROM s) AS need FROM s WHERE rare = 1),
c AS (SELECT id, v, unnest(range(1, CAST(need // n + CASE WHEN turn <= need % n THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM m),
d AS (SELECT a.id, b.id AS neighbour, b.v AS w, row_number() OVER (PARTITION BY a.id ORDER BY {_SQUARE.format(a="a.v", b="b.v")}, b.id) AS rank
      FROM m a JOIN m b ON a.id <> b.id),
k AS (SELECT id, neighbour, w, rank - 1 AS pick, least(count(*) OVER (PARTITION BY id), 5) AS near FROM d WHERE rank <= 5),
g AS (SELECT *, CAST('0x' || substr(sha256(id || '|' || copy || '|n|42'), 1, 15) AS BIGINT) AS hn,
             CAST(CAST('0x' || substr(sha256(id || '|' || copy || '|g|42'), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976.0 AS gap FROM c)
SELECT g.id AS base, copy, neighbour, round(gap, 6) AS gap, {_ADDED} FROM g JOIN k ON k.id = g.id AND k.pick = hn % k.near"""


@register("oversample", ORACLE_OVERSAMPLE)
def q_oversample(spark, sf_dir):
    """The synthetic rows that bring the rare class of the training split up to the other's size."""
    s = train.stratified_split(fixture(spark, sf_dir, RARE, "customer"), "rare", "patient_id").where("NOT is_test")
    made = neighbours.oversample(s, "rare", "patient_id", FEATURES).where(F.col("copy").isNotNull())
    return made.select("base", "copy", "neighbour", *[F.round(c, 6).alias(c) for c in ["gap", *FEATURES]])
