"""Each stream against its batch form, over several micro-batches."""

import hashlib
import hmac

from pyspark.sql import functions as F

from riskframe.operators import ledger
from riskframe.streaming import jobs

KEY = b"test"


def _files(spark, tmp_path, parts, schema):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"p{n}"))
    target = tmp_path / "in"
    target.mkdir()
    for n in range(len(parts)):
        for f in (tmp_path / f"p{n}").glob("*.parquet"):
            f.rename(target / f"{n}.parquet")
    return jobs.file_stream(spark, str(target), schema, max_files=1)


def test_ledger_goes_on_over_batches_and_marks_late_rows(spark, tmp_path):
    parts = [[(1, 1, "a"), (2, 1, "x"), (1, 2, "b")], [(1, 4, "d"), (1, 3, "c"), (3, 9, "z")], [(1, 2, "late"), (2, 5, "y"), (1, 6, "f")]]
    stream = _files(spark, tmp_path, parts, "chain long, seq long, payload string")
    out = jobs.ledger_stream(spark, stream, KEY, "chain", "seq", "payload")
    got = {(r["chain"], r["seq"], r["payload"]): (r["signature"], r["late"]) for r in out.collect()}
    assert got[1, 2, "late"] == (None, True) and len(got) == 9
    want = {}
    for chain, items in {1: [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (6, "f")], 2: [(1, "x"), (5, "y")], 3: [(9, "z")]}.items():
        sig = ""
        for seq, p in items:
            sig = hmac.new(KEY, (p + sig).encode(), hashlib.sha256).hexdigest()
            want[chain, seq, p] = (sig, False)
    assert {k: v for k, v in got.items() if not v[1]} == want
    assert all(r["valid"] for r in ledger.ledger_verify(out.where("NOT late"), KEY, "chain", "seq", "payload").collect())


def test_alerts_count_over_batches(spark, tmp_path):
    parts = [[(n, "HIGH", "t") for n in range(2)], [(n, "HIGH", "t") for n in range(2, 4)], [(9, "CRITICAL", "PII_DETECTED"), (10, "HIGH", "t")]]
    stream = _files(spark, tmp_path, parts, "id long, severity string, event_type string")
    rows = {r["id"]: r for r in jobs.alert_stream(spark, stream, "severity", "event_type", "id").collect()}
    assert [rows[n]["occurrence"] for n in (0, 1, 2, 3, 10)] == [1, 2, 3, 4, 5]
    assert [rows[n]["alert_triggered"] for n in (0, 1, 2, 3, 10, 9)] == [False, False, True, True, True, True]


def test_verify_over_a_long_chain(spark):
    """One chain holds nine tenths of the rows; a changed payload and a changed signature are found."""
    ev = spark.range(3000).select((F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(100)).alias("chain"),
                                  F.col("id").alias("seq"), F.col("id").cast("string").alias("payload"))
    signed = ev.join(ledger.ledger_sign(ev, KEY, "chain", "seq", "payload"), ["chain", "seq"])
    bad = (signed.withColumn("payload", F.when(F.col("seq") == 1111, "x").otherwise(F.col("payload")))
           .withColumn("signature", F.when(F.col("seq") == 2222, "y").otherwise(F.col("signature"))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(r["seq"] for r in ledger.ledger_verify(bad, KEY, "chain", "seq", "payload").where("NOT valid").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [1111, 2222, 2223]
