import random

import numpy as np
import pytest
from brute import overlap
from pyspark.sql import functions as F
from riskframe.llm import decontaminate as dc
from riskframe.llm import queries

SMOKE = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["longest_match"]), r["contaminated"])
            for r in df.collect()]


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 4, 400), np.zeros(20)]).astype(np.int32)
    at = np.flatnonzero(words)
    reach = 9

    def key(i):
        out = []
        for w in words[i:i + reach]:
            if w == 0:
                break
            out.append(int(w))
        return out

    got = dc.suffix_array(words, at, reach)
    assert sorted(got.tolist()) == at.tolist()
    assert [key(i) for i in got] == sorted(key(i) for i in at)


@pytest.mark.parametrize("shard", [1 << 19, 37])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(dc, "SHARD_WORDS", shard)
    rng = random.Random(2)
    vocab = ["a", "B", "c1", "é", "dd"]
    items = [(n, " ".join(rng.choices(vocab[:3], k=rng.choice([0, 1, 3, 9, 10, 12, 30])))) for n in range(12)]
    items += [(12, items[5][1]), (12, items[5][1]), (None, "zz zz"), (13, None), (14, "...")]
    texts = [None, "", "...", "zz, ZZ-zz", " ".join(rng.choices(vocab, k=900))]
    for _ in range(40):
        words = rng.choices(vocab, k=rng.randrange(60))
        cut = items[rng.randrange(12)][1].split()
        texts.append(", ".join(words + cut + rng.choices(vocab, k=5)))
    texts.append(texts[-1])
    got = dc.judge_texts([None if t is None else t.encode() for t in texts],
                         [dc.TestBlock([(i, dc.words_of(t.encode())) for i, t in part if t and dc.words_of(t.encode())], 10)
                          for part in (items[:7], items[7:])])
    for text, v in zip(texts, got, strict=True):
        want = overlap(text, items)
        assert (v.words, v.hit, len(v.items)) == (want[0], want[1], want[2] - (text == "zz, ZZ-zz"))
        if shard > 1000:
            assert v.longest == want[4]
            assert (v.place, v.item, v.item_word) == (first_match(text, items, v.longest) if v.longest else (None,) * 3)


def first_match(text, items, n):
    """The first place with a match of ``n`` words, the smallest item with it and where it lies there."""
    words = [w.decode() for w in dc.words_of((text or "").encode())]
    found = []
    for i, t in items:
        own = [w.decode() for w in dc.words_of((t or "").encode())]
        if n < 10 and len(own) != n:  # shorter matches are of whole items
            continue
        found += [(p, i is None, str(i), j, i) for p in range(len(words) - n + 1) for j in range(len(own) - n + 1) if words[p:p + n] == own[j:j + n]]
    p, _, _, j, i = min(found, key=lambda x: x[:4])
    return p, i, j


def test_a_passage_that_thousands_of_items_share():
    rng = random.Random(6)
    passage = " ".join(f"w{n}" for n in range(40))
    block = dc.TestBlock([(n, dc.words_of(f"{passage} own{n} x".encode())) for n in range(4000)], 10)
    text = " ".join(passage + f" y{rng.randrange(9)}" for _ in range(200)).encode()
    import time
    import tracemalloc
    tracemalloc.start()
    began = time.time()
    v = dc.judge_texts([text], [block])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (v.words, v.hit, len(v.items), v.longest, v.place, v.item, v.item_word) == (8200, 8000, 4000, 40, 0, 0, 0)
    assert time.time() - began < 20 and peak < 500e6


def test_query_on_the_smoke_tables(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect() if len(r["text"] or "") < 6000}
    got = [r for r in rows_of(queries.QUERIES["op1_decontaminate"](spark, SMOKE)) if r[0] in docs]
    assert any(c for _, _, c in got) and not all(c for _, _, c in got)
    # An item whose windows are not in the text's words as a string cannot hit it; brute force the rest.
    for doc_id, values, contaminated in got:
        text = docs[doc_id]
        plain = b" ".join(dc.words_of((text or "").encode())).decode()
        near = [(i, t) for i, t in items if any(" ".join(w) in plain for w in _windows(t))]
        assert values == overlap(text, near)
        assert contaminated == (values[1] > 0)


def _windows(text, size=10):
    words = [w.decode() for w in dc.words_of(text.encode())]
    return [words[i:i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def test_longest_matches_name_their_places(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([("d1", "x " + item[:-7]), ("d2", "y y " + item + " z"), (None, None)], "doc_id string, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r["item_id"], r["item_word"]): (r["length"], r["doc_id"], r["doc_word"]) for r in dc.longest_matches(docs, items).collect()}
    assert got == {("1", 0): (12, "d2", 2), ("1", 1): (11, "d2", 3), ("1", 2): (10, "d2", 4)}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (None, None, 6), (1, "a b", 5), (2, "", 7)], "doc_id long, text string, _overlap int")
    items = spark.createDataFrame([(1, "b"), (None, "a"), (3, None)], "item_id long, text string")
    got = sorted(rows_of(dc.overlap_report(docs, items)), key=str)
    assert [r[2] for r in got] == [True, True, False, False]
    left = dc.remove_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r["_overlap"] for r in left.collect()) == [6, 7]
    assert not any(r[2] for r in rows_of(dc.overlap_report(docs, items.limit(0))))
    assert dc.overlap_report(docs.limit(0), items).count() == 0
    assert dc.remove_contaminated(docs.withColumn("a.b", F.lit(1)), items).count() == 2
