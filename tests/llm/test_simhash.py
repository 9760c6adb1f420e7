import random

from brute import fingerprint, groups
from pyspark.sql import functions as F
from riskframe.llm import queries, simhash

SMOKE = "/root/testdata/sf0.001"


def test_fingerprint_is_the_stated_one():
    for t in ["", " ", "One", "one TWO", "a b c", "a b c d e a b c", "é ü\tß\x0bx\x0cy\rz\n1", "word " * 50_000]:
        assert simhash.fingerprint(t.encode()) == (fingerprint(t) if len(t) < 1000 else fingerprint("word " * 50))


def test_links_are_complete(spark):
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5):
        prints = {rng.getrandbits(64) for _ in range(60)} | {0}
        for p in list(prints):
            for d in range(1, 7):
                prints.add(p ^ sum(1 << b for b in rng.sample(range(64), d)))
        for _ in range(200):  # crowded: one half in common
            prints.add(rng.getrandbits(9) << 40)
        prints = sorted(prints)
        signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
        got = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in
               simhash.links(spark.createDataFrame(signed, "fp long"), "fp", k).collect()}
        want = {(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= k}
        assert {tuple(sorted(x)) for x in got} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (5001, 5000)]
    random.Random(4).shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)} | {5001: 5000}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_on_the_smoke_tables(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect())
    prints = [fingerprint(t) for _, t in docs]
    root = groups(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op4_simhash"](spark, SMOKE).collect()}
    assert got == {d: (f"{p:016x}", docs[root[n]][0]) for n, ((d, _), p) in enumerate(zip(docs, prints, strict=True))}
    assert len(set(root)) < len(root)


def test_odd_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "A B  c d"), (7, None), (6, " "), (None, ""), (9, "other text here"), (None, "lone one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_fp", F.lit("x")).withColumn("fp", F.lit(1))
    got = sorted(((str(r["doc_id"]), r["fingerprint"] == "0" * 16, r["component_id"])
                  for r in simhash.near_duplicate_groups(docs).collect()), key=str)
    assert got == sorted([("5", False, 5)] * 2 + [("None", False, 5), ("7", True, 6), ("6", True, 6), ("None", True, 6),
                                                  ("9", False, 9), ("None", False, None)], key=str)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "6", "9", "None"]
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == simhash.keep_one_of_each(docs.limit(0)).count() == 0
