import math
import random
from collections import Counter

from riskframe.operators import text


def brute(corpus, queries, k, min_score):
    tf = {d: Counter(t.split()) for d, t in corpus if t is not None}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(corpus)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(counts):
        v = {w: n * idf[w] for w, n in counts.items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {d: unit(c) for d, c in tf.items() if c}
    out = []
    for q, t in queries:
        own = unit(Counter((t or "").split()))
        scores = [(round(sum(own.get(w, 0) * x for w, x in v.items()), 9), d) for d, v in vectors.items()]
        best = sorted(scores, key=lambda s: (-s[0], -s[1]))[:k]
        out += [(q, n, d, round(s, 4)) for n, (s, d) in enumerate(best, start=1) if s > min_score]
    return sorted(out)


def test_same_rows_as_scoring_every_pair(spark):
    rng = random.Random(9)
    common, rare = ["the", "ofx", "andy"], [f"word{n}" for n in range(400)]
    corpus = [(n, " ".join(rng.choices(common, k=rng.randrange(40)) + rng.choices(rare, k=rng.randrange(1, 60)))) for n in range(500)]
    corpus += [(500 + n, corpus[7][1]) for n in range(30)] + [(600, None), (601, ""), (602, "the"), (603, "word1")]
    queries = [(n, " ".join(rng.choices(common, k=4) + corpus[rng.randrange(500)][1].split()[-25:])) for n in range(25)]
    queries += [(100, None), (101, "unseen"), (102, "the"), (103, corpus[7][1])]
    docs = spark.createDataFrame(corpus, "id long, t string").repartition(4)
    asked = spark.createDataFrame(queries, "qid long, t string").repartition(2)
    got = text.tfidf_search(docs, "id", "t", asked, "qid", "t", top_k=4, stop_words=[]).collect()
    assert sorted(tuple(r) for r in got) == brute(corpus, queries, 4, 0.05)
    scored = {r["query_id"]: r["n"] for r in
              text.pruned_search(docs, "id", "t", asked, "qid", "t", top_k=4, stop_words=[]).scored.collect()}
    assert sum(scored.values()) < 0.5 * len(corpus) * len(queries)
    every = text.pruned_search(docs, "id", "t", asked, "qid", "t", top_k=4, stop_words=[], left_out_share=0.0)
    some = text.pruned_search(docs, "id", "t", asked, "qid", "t", top_k=4, stop_words=[], left_out_share=1.0)
    rounded = lambda s: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in s.found.collect())
    assert rounded(every) == rounded(some)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "id long, t string")
    assert text.tfidf_search(docs.limit(0), "id", "t", docs, "id", "t").collect() == []
    assert text.tfidf_search(docs, "id", "t", docs.limit(0), "id", "t").collect() == []
