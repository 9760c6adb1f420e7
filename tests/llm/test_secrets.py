from brute import base_spans, sha
from pyspark.sql import functions as F
from riskframe.llm import queries, secret_scan

SMOKE = "/root/testdata/sf0.01"
NAMES = ("assign", "access", "hex")


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts, strict=True):
        spans = base_spans(text)
        listed = ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)], text
        assert r["base_sha256"] == sha(listed)
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))


def test_query_on_the_small_tables(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect())
    got = sorted(queries.QUERIES["op3_secret_scan"](spark, SMOKE).collect(), key=lambda r: r["doc_id"])
    check(got, [t for _, t in docs])
    assert sum(r["n_assign"] for r in got) > 0


TEXTS = [None, "", "no", "Password=abc", "🦙 TOKEN = 'abcdef' x", "token=token: abcdefgh", "api_key: \"Zz9/+=.-_\" apikey=abcdef",
         "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 20, "f" * 23, "é" + "0a" * 12 + "g" + "9" * 40,
         "secret=" + "0123456789abcdef" * 4, "passwd : x secret:yyyyyy", ("token=abcdef1 " * 3000), "Key secret=ſecret",
         "ghp_" + "a1B2" * 9, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2QT4", "password\n=\nabcdefgh", "a\x00token=qwerty1"]


def test_odd_texts(spark):
    rows = [(n, t, "s", None) for n, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, "x"), (4, TEXTS[4], "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("rid", F.lit(0)).withColumn("_found", F.lit(0))
    place = lambda n: 99 if n is None else n
    got = sorted(secret_scan.secret_report(docs).collect(), key=lambda r: place(r["doc_id"]))
    check(got, [t for _, t, _, _ in sorted(rows, key=lambda r: place(r[0]))])
    assert secret_scan.secret_report(docs.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = queries.QUERIES["op3_secret_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_ownership_separates_examples_from_live_values(spark):
    copied, own = "ghp_" + "Ab1c" * 9, "ghp_" + "Zx9y" * 9
    rows = [(n, f"see {copied} and token=abcdefgh", f"owner{n}", "en") for n in range(4)] + [(9, f"mine {own} here", "owner1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in secret_scan.secret_report(docs).collect()}
    assert "vendor" not in got[0]["spans"] and got[0]["n_example"] == 2 and got[0]["n_assign"] == 1
    assert "vendor:5:45" in got[9]["spans"] and got[9]["n_live"] >= 0


def test_redaction(spark):
    rows = [(1, "é token=abcdefgh, then secret=" + "0123456789abcdef" * 2 + " end", "a", "en", 0), (2, "clean", "a", "en", 0),
            (None, None, None, None, None), (3, "password=qwerty9", "b", "en", 0), (3, "password=qwerty9", "b", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("_cuts", F.lit(1))
    out = secret_scan.redact(docs, size_col="n_chars")
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in out.collect() if r["text"])
    assert got == [("1", "é [SECRET], then [SECRET] end", 29), ("2", "clean", 0), ("3", "[SECRET]", 8), ("3", "[SECRET]", 8)]
    assert out.count() == 5 and secret_scan.redact(docs.limit(0)).count() == 0
