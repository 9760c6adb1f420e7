import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskframe.operators import text


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_that_go_on_over_several_batches_are_counted_whole(spark, small_batches):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "the"], k=n)) for n in (0, 1, 4, 5, 40, 3, 200, 0, 12, 13, 7, 100)]
    rows = list(enumerate(texts)) + [(50, None), (51, "the the"), (None, "aa bb"), (6, texts[6]), (52, "aa " * 30), (53, "the " * 40)]
    got = text.local_term_counts(spark.createDataFrame(rows, "id long, t string").coalesce(1), "id", "t", ["the"], piece_words=4).collect()
    expected = []
    for i, t in rows:
        tf = Counter(w for w in (t or "").split() if w != "the")
        expected += [(i, len(tf), w, n) for w, n in tf.items()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in got), key=order) == sorted(expected, key=order)


def test_python_gets_a_bounded_number_of_words_a_row(spark, monkeypatch):
    seen = []

    def spy(df, *args, **kw):
        seen.append(df)
        return real(df, *args, **kw)

    docs = spark.createDataFrame([(1, "word " * 5000), (2, "few words")], "id long, t string")
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", spy)
    out = text.local_term_counts(docs, "id", "t").collect()
    monkeypatch.undo()
    assert seen[0].agg(F.max(F.size("words"))).first()[0] <= text.PIECE_WORDS
    assert sorted((r["doc_id"], r["n_terms"], r["term"], r["tf"]) for r in out) == [(1, 1, "word", 5000), (2, 1, "words", 1)]
