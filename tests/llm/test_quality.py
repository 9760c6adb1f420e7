import zlib

import numpy as np
from brute import base_rules
from pyspark.sql import functions as F
from riskframe.llm import quality_classifier as qc
from riskframe.llm import quality_rules as qr
from riskframe.llm import queries

SMALL = "/root/testdata/sf0.01"
TEXTS = [None, "", " \n\t", "a b c a b c\nx\r\nx\r\n\n\n", "é ü  é#", "one " * 60, "w " * 40_000, "line\nline\n line\nline",
         " ".join(f"word{i}" for i in range(60)), "  a b"]


def counts_of(r):
    return (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])


def test_base_counts_of_odd_rows(spark):
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_rules", F.lit(0)).withColumn("kept", F.lit(True))
    labels = spark.createDataFrame([(8, 1, 0), (None, 1, 0), (3, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted((str(r["doc_id"]), counts_of(r)) for r in qr.quality_report(docs, labels).collect())
    assert got == sorted((str(i), base_rules(t)) for i, t in rows)
    kept = qr.keep_quality(docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [8]
    assert qr.quality_report(docs.limit(0), labels).count() == 0
    assert {r["llr"] for r in qr.quality_report(docs, labels.limit(0)).collect()} == {0.0}


def test_query_counts_and_verdicts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_rules"](spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    assert all(counts_of(got[d]) == base_rules(t) for d, t in texts.items())
    passed = [d for d in good if not got[d]["base_failed"]]
    assert np.mean([got[d]["kept"] for d in passed if good[d] == 1]) > 0.98
    assert np.mean([got[d]["kept"] for d in passed if good[d] == 0]) < 0.2


def test_ratio_is_that_of_the_counts(spark):
    docs = spark.createDataFrame([(1, "A b b"), (2, "b, c")], "doc_id long, text string")
    marked = qr.mark_target(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), "doc_id", "t")
    counts = qr.ngram_counts(marked, "text", "t", 1 << 16).collect()
    # Tokens a b b | b , c with their pairs; no pair goes from one text into the next.
    assert sum(r["raw"] for r in counts) == 5 + 5 and sum(r["target"] for r in counts) == 5
    ratio = qr.fit_ratio(qr.ngram_counts(marked, "text", "t", 8), 8)
    raw, target = np.zeros(8), np.zeros(8)
    for r in qr.ngram_counts(marked, "text", "t", 8).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    assert np.allclose(ratio, np.log((target + 1) / (target.sum() + 8)) - np.log((raw + 1) / (raw.sum() + 8)))


def test_discriminant_against_plain_formula(spark):
    rng = np.random.default_rng(5)
    d = len(qc.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (80, d)), rng.normal(1, 2, (60, d))])
    y = [0] * 80 + [1] * 60
    rows = spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, y, strict=True)], "stats array<double>, y int")
    model = qc.fit(rows, "stats", "y")
    y = np.array(y)
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (80 * covs[0] + 60 * covs[1]) / 140
    logs = []
    for k, c in enumerate(covs):
        c = 0.7 * c + 0.3 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
        diff = x - x[y == k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff) - 0.5 * np.linalg.slogdet(c)[1] + np.log((80, 60)[k]))
    assert np.allclose(qc.scores(x, model), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_classifier_held_out(spark):
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_quality_classifier"](spark, SMALL).collect()}
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [d for d in good if got[d]["held_out"]]
    pos = [got[d]["score"] for d in held if good[d] == 1]
    neg = [got[d]["score"] for d in held if good[d] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9
    assert np.mean([got[d]["predicted"] == good[d] for d in held]) > 0.9


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)] + [(None, "x"), (1, "")], "doc_id long, text string").withColumn(
        "stats", F.lit(1))
    labels = spark.createDataFrame([(1, 0, 0), (8, 1, 0), (8, 0, 0), (5, 1, 0), (3, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    held = queries.fold("doc_id", 4) == 2
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        got = qc.quality_scores(docs, known, held).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert qc.quality_scores(docs.limit(0), labels, held).count() == 0


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s, s.translate(str.maketrans(a + b, b + a))


def test_lines_and_words_whose_hashes_collide():
    one, other = thue_morse(2048)
    texts = [f"{one}\n{other}", f"{one}\n{other}\n{one}", f"x {one} y x {other} y", f"x {one} y x {other} y x {one} y"]
    stats = qr.TextStats(8)
    hasher = qr.RunHasher()
    data = np.frombuffer((one + other).encode(), np.uint8)
    sums = hasher.sums(stats.value[data])
    assert len(set(hasher.hashes(sums, np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 1  # such lines do collide
    got = stats.counts([t.encode() for t in texts])
    assert [tuple(c) for c in got.T.tolist()] == [base_rules(t)[:5] for t in texts]


def test_every_trusted_document_is_counted(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality")).unionByName(docs.select("doc_id", F.lit(1).alias("quality")).limit(5))
    marked = qr.mark_target(docs, labels, "doc_id", "trusted")
    trusted = {r["doc_id"] for r in labels.where("quality = 1").select("doc_id").distinct().collect()}
    assert {r["doc_id"] for r in marked.where("trusted").collect()} == trusted and marked.count() == 3000
    assert sum(r["target"] for r in qr.ngram_counts(marked, "text", "trusted").collect()) == 3 * len(trusted)
