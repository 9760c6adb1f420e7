import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from brute import lower_ascii
from riskframe.llm import spelling

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType()),
                     T.StructField("n", T.LongType()), T.StructField("key", T.StringType()), T.StructField("i", T.LongType())])


def near(a, b):
    """Whether two different words differ by one letter put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(counts, ratio=5):
    form, out = {}, []
    others = {w: [o for o in counts if near(w, o)] for w in counts}
    for w, n in counts.items():
        best = min(others[w], key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(others[w]), counts.get(form.get(w))))
    return sorted(out, key=str)


def variants(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    return sorted([tuple(r) for r in spelling.spelling_variants(df).collect()], key=str)


def test_random_words_against_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 6))) for _ in range(400)}
    words |= {"x" * 63, "x" * 64, "x" * 65, "x" * 66, "x" * 64 + "y", "x" * 65 + "y", "y" + "x" * 65, "x" * 40 + "z" + "x" * 24, "q" * 3000, "q" * 2999}
    counts = {w: int(5 ** rng.randrange(1, 9)) + rng.randrange(2) for w in sorted(words)}
    assert variants(spark, counts) == brute(counts)


def test_group_goes_on_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        counts = {"word" + c + "end": 5 + ord(c) for c in "abcdefghijkl"} | {"wordend": 9000}
        assert variants(spark, counts) == brute(counts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_ties_take_the_smallest_word_and_chains_lead_to_the_end(spark):
    counts = {"abcdefg": 5, "abcdefh": 25, "abcdefi": 25, "abcdeff": 24, "abcdxfh": 125, "abcyxfh": 625, "zzzzzz": 7}
    got = {r[0]: r for r in variants(spark, counts)}
    assert got["abcdefg"][1] == "abcdefh" and got["abcdefg"][2] == "abcyxfh" and got["zzzzzz"] == ("zzzzzz", None, "zzzzzz", 7, 0, None)
    assert sorted(got.values(), key=str) == brute(counts)


def test_counts_of_documents(spark):
    rng = random.Random(4)
    words = ["Straße", "straßen", "École", "écoles", "naïveté", "foobar", "FOOBAR", "fooBär", "abc", "x" * 300]
    rows = [(n % 700 if n % 50 else None, rng.choice([" ", "1", "-", "ſ"]).join(rng.choices(words, k=9))) for n in range(900)]
    rows += [(1, None), (2, ""), (3, "words of few"), *[(5, "foobar2foobar")] * 3]
    want = {}
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower_ascii(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 7 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                want[w] = want.get(w, 0) + 1
    df = spark.createDataFrame([(*r, "w", 1, "k", 2) for r in rows], DOCS).repartition(3)
    got = {r["word"]: r["n"] for r in spelling.counted_words(df, thin_every=7).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}


def test_empty_tables(spark):
    none = spelling.counted_words(spark.createDataFrame([], DOCS), thin_every=199)
    assert spelling.spelling_variants(none).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(none, ratio=1)
