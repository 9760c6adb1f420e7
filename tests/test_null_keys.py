import hashlib
import hmac

from pyspark.sql import functions as F

from riskframe.operators import alerts, clean, eda, ledger, stats, train
from riskframe.streaming import jobs

KEY = b"k"


def test_alert_counts_keep_null_keys(spark):
    ev = spark.createDataFrame([(1, None, "A"), (2, None, "A"), (3, "HIGH", None), (4, "HIGH", "A")], "id long, s string, t string")
    got = {r["id"]: r["occurrence"] for r in alerts.alert_threshold(ev, "s", "t", "id").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1}


def test_split_keeps_rows_without_label_or_key(spark):
    rows = [(n, [0, 1, None][n % 3]) for n in range(30)] + [(None, 1), (None, None)]
    df = spark.createDataFrame(rows, "id long, y int")
    got = train.stratified_split(df, "y", "id")
    assert got.count() == 32
    per = {r["y"]: r["t"] for r in got.groupBy("y").agg(F.count_if("is_test").alias("t")).collect()}
    assert per == {0: 2, 1: 2, None: 2}


def test_wilcoxon_and_box_keep_the_null_group(spark):
    rows = [(g, float(n), float(n * n % 7)) for g in ("a", None) for n in range(1, 9)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    a, b = (r.asDict() for r in stats.wilcoxon_signed_rank(df, "g", "x", "y").collect())
    assert {a.pop("g"), b.pop("g")} == {"a", None} and a == b
    assert eda.box_by_class(df, "g", ["x"]).count() == 2


def signed(spark, rows):
    df = spark.createDataFrame(rows, "chain long, seq long, payload string")
    return df.join(ledger.ledger_sign(df, KEY, "chain", "seq", "payload").withColumnsRenamed({"chain": "c", "seq": "s"}),
                   F.col("chain").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("s"))).drop("c", "s")


def summary(spark, rows):
    return {r["chain"]: (r["checked"], r["tampered"], r["status"])
            for r in ledger.verify_summary(ledger.ledger_verify(rows, KEY, "chain", "seq", "payload"), "chain").collect()}


def test_ledger_with_null_chain_and_payload(spark):
    big = (1 << 53) + 1
    rows = [(None, 1, "a"), (None, 2, None), (None, 3, "b"), (big, 1, None), (big, 2, "c")]
    s = signed(spark, rows)
    first = hmac.new(KEY, b"a", hashlib.sha256).hexdigest()
    second = hmac.new(KEY, b"\0" + first.encode(), hashlib.sha256).hexdigest()
    got = {(r["chain"], r["seq"]): r["signature"] for r in s.collect()}
    assert len(got) == 5 and (got[None, 1], got[None, 2]) == (first, second)
    assert summary(spark, s) == {None: (3, 0, "VERIFIED"), big: (2, 0, "VERIFIED")}


def test_an_erased_payload_is_found(spark):
    s = signed(spark, [(1, 1, "a"), (1, 2, "b"), (2, 1, "x")])
    erased = s.withColumn("payload", F.when((F.col("chain") == 1) & (F.col("seq") == 2), None).otherwise(F.col("payload")))
    assert summary(spark, erased) == {1: (2, 1, "TAMPERED"), 2: (1, 0, "VERIFIED")}


def test_quality_score_and_friedman_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b double, v double")
    r = clean.quality_score(none).first()
    assert (r["rows"], r["quality_score"], r["gate"]) == (0, None, "FAIL")
    f = stats.friedman(none, "a", "b", "v").first()
    assert (f["blocks"], f["k"], f["q_stat"], f["dof"]) == (0, 0, None, 0)


def test_ledger_stream_keeps_duplicates_and_null_chains(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "chain long, seq long, payload string"
    batches = [[(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (None, 1, "n"), (None, None, "q")], [(1, 2, "late"), (1, 3, "c"), (None, 2, None)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, spark.read.parquet(folder).schema, max_files=1)
    got = jobs.ledger_stream(spark, stream, KEY, "chain", "seq", "payload").collect()
    assert len(got) == 8
    on_time = sorted((str(r["chain"]), r["seq"]) for r in got if not r["late"])
    assert on_time == [("1", 1), ("1", 2), ("1", 3), ("None", 1), ("None", 2)]
    assert all((r["signature"] is None) == r["late"] for r in got)
    rows = spark.createDataFrame([(r["chain"], r["seq"], r["payload"], r["signature"]) for r in got if not r["late"]],
                                 "chain long, seq long, payload string, signature string")
    assert {c: s for c, (_, _, s) in summary(spark, rows).items()} == {1: "VERIFIED", None: "VERIFIED"}


def test_streamed_verification_agrees_with_the_batch(spark, tmp_path):
    folder = str(tmp_path / "signed")
    rows = [(c, n, f"{c}-{n}") for c in (1, 2, None) for n in range(1, 9)]
    s = signed(spark, rows)
    bad = s.withColumn("payload", F.when((F.col("chain") == 1) & (F.col("seq") == 5), "edited")
                       .when((F.col("chain") == 2) & (F.col("seq") == 3), None).otherwise(F.col("payload")))
    late = bad.where("chain = 1 AND seq = 2")
    for part in (bad.where("seq <= 3"), bad.where("seq BETWEEN 4 AND 6").unionByName(late), bad.where("seq > 6").unionByName(bad.where("chain = 2 AND seq = 8"))):
        part.coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(1, 99, "x", None)], bad.schema).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, bad.schema, max_files=1)
    got = [(r["chain"], r["seq"], r["status"]) for r in jobs.verify_stream(spark, stream, KEY, "chain", "seq", "payload").collect()]
    batch = ledger.ledger_verify(bad, KEY, "chain", "seq", "payload")
    want = [(r["chain"], r["seq"], "VERIFIED" if r["valid"] else "TAMPERED") for r in batch.collect()]
    assert sorted(got, key=str) == sorted([*want, (1, 2, "LATE"), (2, 8, "LATE"), (1, 99, "UNSIGNED")], key=str)
    assert sorted((c, n) for c, n, x in want if x == "TAMPERED") == [(1, 5), (2, 3)]
