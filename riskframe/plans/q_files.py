"""Registered queries of file formats, stage messages, rankings, sparse encodings and the fitted index
(S-1, S-2, L-3, K-5, D-21, R-2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.operators import features, ledger, text
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.q_text import ORACLE_TFIDF
from riskframe.plans.registry import fixture, register
from riskframe.session import checkpoint_path
from riskframe.sources import files
from riskframe.sources.tables import table

ORACLE_FORMATS = "\nUNION ALL ".join(
    f"SELECT '{f}' AS format, c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IS NOT NULL" for f in ("csv", "json", "parquet"))


@register("format_read", ORACLE_FORMATS)
def q_formats(spark, sf_dir):
    """Every customer, written as CSV, JSON and Parquet and read back by extension from what file discovery lists."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    root = checkpoint_path(spark, f"formats-{uuid.uuid4().hex}")
    for f in ("csv", "json", "parquet"):
        files.write_any(rows, f"{root}/customer.{f}")
    listed = files.discover_files(spark, root, suffixes=(".csv", ".parquet", ".txt"))
    folders = listed.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).distinct().collect()  # a row a table
    out = None
    for name in sorted(r["folder"] for r in folders):
        got = files.read_any(spark, f"{root}/{name}").select(
            F.lit(name.rsplit(".", 1)[1]).alias("format"), F.col("c_custkey").cast("long").alias("c_custkey"),
            F.col("c_name").cast("string").alias("c_name"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
        out = got if out is None else out.unionByName(got)
    return out


ORACLE_HANDOFF = """SELECT event_id, 'stage-' || s AS sender, 'stage-' || (s + 1) AS receiver, 'handoff' AS message_type, sha256(coalesce(props, '')) AS checksum
FROM (SELECT event_id, props, 1 + event_id % 15 AS s FROM events) e WHERE s < 15"""


@register("handoff_messages", ORACLE_HANDOFF)
def q_handoff(spark, sf_dir):
    """The message that each completed stage event sends to the next of fifteen stages."""
    done = table(spark, sf_dir, "events").select("event_id", (1 + F.col("event_id") % 15).alias("stage"), F.col("props").alias("artifact"))
    stages = spark.range(1, 16).select(F.col("id").alias("stage"), F.concat(F.lit("stage-"), F.col("id").cast("string")).alias("name"))
    return ledger.handoff_messages(done, stages).select("event_id", "sender", "receiver", "message_type", "checksum")


RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLE_RANKING = f"WITH b AS ({fx.LINEITEM_LABELLED}), c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, label), 4) AS corr FROM b" for c in RANKED) + \
    ") SELECT feature, corr, abs(corr) AS abs_corr, CAST(row_number() OVER (ORDER BY abs(corr), feature) AS INTEGER) AS rank FROM c"


@register("correlation_ranking", ORACLE_RANKING)
def q_ranking(spark, sf_dir):
    """Features from the weakest to the strongest correlation with the label."""
    return features.correlation_ranking(fixture(spark, sf_dir, fx.LINEITEM_LABELLED, "lineitem"), "label", RANKED)


ORACLE_SPARSE = """WITH u AS (SELECT o_orderkey, 0 AS c, o_orderpriority AS v FROM orders UNION ALL SELECT o_orderkey, 1, CAST(o_custkey AS VARCHAR) FROM orders),
l AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS n FROM (SELECT DISTINCT c, v FROM u WHERE v IS NOT NULL) x),
i AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS index FROM l WHERE n > 1)
SELECT o_orderkey, coalesce(list_sort(list(CAST(index AS BIGINT)) FILTER (WHERE index IS NOT NULL)), []) AS indices
FROM u LEFT JOIN i ON u.c = i.c AND u.v = i.v GROUP BY o_orderkey"""


@register("one_hot_sparse", ORACLE_SPARSE)
def q_sparse(spark, sf_dir):
    """One-hot places of every order's priority and customer, a level for each customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return features.one_hot_sparse(orders, "o_orderkey", ["o_orderpriority", "o_custkey"])[0]


_FITTED = ORACLE_TFIDF[:ORACLE_TFIDF.index("qt AS (")].rstrip().rstrip(",")


@register("tfidf_index", _FITTED + """ SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS top_weight
FROM dw GROUP BY doc_id""")
def q_index(spark, sf_dir):
    """The fitted TF-IDF weights of every whole document: their number, sum and largest."""
    weights, _ = text.tfidf_fit(table(spark, sf_dir, "documents"), "doc_id", "text")
    return weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
                                         F.round(F.max("weight"), 6).alias("top_weight"))
