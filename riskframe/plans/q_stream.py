"""Registered streaming queries (T-1..T-3): the file source replays the
events table; results are read back from what the jobs wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import ledger
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.q_ops import ORACLE_ALERTS, ORACLE_SIGN, TEST_KEY
from riskframe.plans.registry import register
from riskframe.session import written
from riskframe.sources.tables import table
from riskframe.streaming import jobs


def _events_stream(spark, sf_dir):
    return jobs.file_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, glob="events.parquet")


@register("alert_threshold_stream", ORACLE_ALERTS)
def q_alert_stream(spark, sf_dir):
    """Streaming keyed alert counts over the events file source (availableNow)."""
    ev = _events_stream(spark, sf_dir)
    sev = ev.select("event_id", F.upper("event_type").alias("event_type"),
                    F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "HIGH")
                    .when(F.col("event_type") == "signup", "MEDIUM").otherwise("LOW").alias("severity"))
    return jobs.alert_stream(spark, sev, "severity", "event_type", "event_id")


@register("ledger_stream", f"SELECT user_id AS chain, event_id AS seq, signature, false AS late FROM ({ORACLE_SIGN}) s")
def q_ledger_stream(spark, sf_dir):
    """Streaming HMAC ledger per user over the events file source (availableNow)."""
    ev = _events_stream(spark, sf_dir).select("event_id", "user_id",
                                               F.concat("event_type", F.lit(":"), "props").alias("payload"))
    return jobs.ledger_stream(spark, ev, TEST_KEY, "user_id", "event_id", "payload").drop("payload")


ORACLE_VERIFY_ROWS = f"""WITH s AS ({ORACLE_SIGN}),
e AS (SELECT event_id, user_id, event_type || ':' || props AS payload FROM events)
SELECT s.user_id AS chain, s.event_id AS seq, CASE WHEN s.event_id % 101 = 0 AND payload IS NOT NULL THEN 'TAMPERED' ELSE 'VERIFIED' END AS status
FROM s JOIN e ON e.event_id = s.event_id"""


@register("ledger_verify_stream", ORACLE_VERIFY_ROWS)
def q_verify_stream(spark, sf_dir):
    """Every signed event, the payload of some edited, verified while it streams in."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat("event_type", F.lit(":"), "props").alias("payload"))
    signed = ledger.ledger_sign(ev, TEST_KEY, "user_id", "event_id", "payload")
    edited = F.when(F.col("event_id") % 101 == 0, F.concat("payload", F.lit(" (edited)"))).otherwise(F.col("payload"))
    rows = written(ev.join(signed, ["user_id", "event_id"]).withColumn("payload", edited), "signed_events")
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    return jobs.verify_stream(spark, stream, TEST_KEY, "user_id", "event_id", "payload")


def _scored(spark, sf_dir, name):
    cust = jobs.file_stream(spark, sf_dir, table(spark, sf_dir, "customer").schema, glob="customer.parquet")
    cust.createOrReplaceTempView("customer_stream")
    v = spark.sql(fx.VITALS.replace("FROM customer", "FROM customer_stream"))
    broken = v.withColumn("gender", F.when(F.col("patient_id") % 11 == 0, F.lit(0)).otherwise(F.col("gender")))
    out = jobs.scoring_stream(broken).select("patient_id", F.round("probability", 6).alias("probability"), "valid", "violations")
    return jobs.run_available_now(spark, out, name)


_STREAM_SCORE = f"""round(least(greatest(0.1 + age / 100.0 + (ap_hi + ap_lo - 120.0) / 100.0 + cholesterol * 0.15 + gluc * 0.1
  + CASE WHEN active = 0 THEN 0.1 ELSE 0.0 END + CASE WHEN smoke = 1 THEN 0.12 ELSE 0.0 END, 0.05), 0.95), 6)"""


@register("scoring_stream", f"WITH v AS ({fx.VITALS}) SELECT patient_id, {_STREAM_SCORE} AS probability FROM v WHERE patient_id % 11 <> 0")
def q_scoring_stream(spark, sf_dir):
    """Stateless streaming scoring of customer-derived vitals: the accepted rows."""
    return jobs.accepted(_scored(spark, sf_dir, "scoring")).select("patient_id", "probability")


@register("scoring_rejects", f"WITH v AS ({fx.VITALS}) SELECT patient_id, ['gender_range'] AS violations FROM v WHERE patient_id % 11 = 0")
def q_scoring_rejects(spark, sf_dir):
    """The rows that streaming scoring rejects, with the rules they break."""
    return jobs.rejected(_scored(spark, sf_dir, "rejects")).select("patient_id", "violations")
