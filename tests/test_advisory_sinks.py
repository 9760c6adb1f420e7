import json

from riskframe.plans import q_more, q_train

SMOKE = "/root/testdata/sf0.001"


def test_whole_text_scan_has_every_order_in_bounded_files(spark):
    keys = [r[0] for r in spark.read.parquet(f"{SMOKE}/orders.parquet").select("o_orderkey").collect()]
    assert len(set(keys)) == len(keys)
    exp = {}
    for k in keys:
        exp.setdefault(f"block={k // 1000}", []).append(f"order {k}")
    got = {r["source"]: r["text"] for r in q_more.q_whole_text(spark, SMOKE).collect()}
    assert got == {b: "\n".join(sorted(lines)) + "\n" for b, lines in exp.items()}
    assert len(got) > 1 and max(t.count("\n") for t in got.values()) <= 1000


def test_questions_and_reports_hold_the_whole_text(spark, tmp_path):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    assert len(long) > 60
    # Found, linked and reported by words after the first 60 characters alone.
    spark.createDataFrame([(3, long + "needle cholesterol")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "needle haystack"), (2, "other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = q_more.q_advisory(spark, str(tmp_path)).collect()
    assert f'"{long}needle cholesterol"' in row["report"] and "> **Section from doc-1:**" in row["report"]
    assert "doc-2" not in row["report"] and "high-intensity statin" in row["report"]
    (answer,) = q_more.q_guarded(spark, str(tmp_path)).collect()
    assert row["report"] == answer["answer"] or not answer["safe"]


def test_fitted_importance_has_the_benchmark_settings(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    fitted, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, *a, **kw: fitted.append(self) or fit(self, *a, **kw))
    got = q_train.q_fitted_importance(spark, SMOKE).collect()
    rows = spark.read.parquet(f"{SMOKE}/customer.parquet").count()
    (lr,) = fitted
    assert lr.getMaxIter() == 1000 and lr.getRegParam() == 1.0 / rows and not lr.getStandardization()
    assert {r["feature"] for r in got} == set(q_train.FEATURES)


def test_json_documents_has_a_document_per_order(spark):
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    exp = {r["o_orderkey"]: {c: r[c] for c in cols} for r in spark.read.parquet(f"{SMOKE}/orders.parquet").collect()}
    got = {r["o_orderkey"]: json.loads(r["document"]) for r in q_more.q_json_documents(spark, SMOKE).collect()}
    assert got == exp
