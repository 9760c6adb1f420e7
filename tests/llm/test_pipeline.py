import corpus_pipeline
import numpy as np
from brute import base_rules, base_spans, fingerprint, groups, overlap
from riskframe.llm import quality_rules
from riskframe.llm import sentencepiece_codec as codec
from riskframe.llm.unigram_vocab import load_vocab

SMOKE = "/root/testdata/sf0.001"


def brute_pipeline(docs, labels, items, llr):
    """The kept texts, stage by stage, one document after another."""
    docs = [(d, t, s) for d, t, s in docs if not base_rules(t)[-1] and llr[d] >= quality_rules.THRESHOLD]
    docs.sort()
    root = groups([fingerprint(t) for _, t, _ in docs])
    docs = [x for n, x in enumerate(docs) if root[n] == n]
    docs = [x for x in docs if not overlap(x[1], [(i, t) for i, t in items if shares(x[1], t)])[1]]
    owners = {}
    for _, t, s in docs:
        for a, k, b in base_spans(t):
            owners.setdefault(value(t[a:b], k), set()).add(s)
    out = {}
    for d, t, _ in docs:
        spans = [(a, b) for a, k, b in base_spans(t) if len(owners[value(t[a:b], k)]) < 3]
        merged = []
        for a, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            t = t[:a] + "[SECRET]" + t[b:]
        out[d] = t
    return out


def value(match, kind):
    from brute import ASSIGN
    return ASSIGN.match(match)[2] if kind == 0 else match


def shares(text, item):
    from riskframe.llm.decontaminate import words_of
    words, item = words_of(text.encode()), words_of(item.encode())
    grams = {tuple(words[i:i + 10]) for i in range(len(words))}
    return any(tuple(item[i:i + 10]) in grams for i in range(len(item)))


def test_pipeline_against_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SMOKE}/{t}.parquet")
    docs = [(r["doc_id"], r["text"] or "", r["source"]) for r in read("documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    llr = {r["doc_id"]: r["llr"] for r in quality_rules.quality_report(read("documents"), read("labels")).collect()}
    want = brute_pipeline(docs, None, items, llr)
    vocab = load_vocab(corpus_pipeline.PIECE_MODEL)
    got = {r["doc_id"]: codec.decode_ids(np.array(r["ids"], np.int64), vocab.texts, True).decode()
           for r in corpus_pipeline.run(spark, SMOKE).collect()}
    assert got == want
    assert 0 < len(got) < len(docs)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    extra = docs.selectExpr("*", "doc_id AS rid", "text AS _text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, extra, docs.limit(0)):
            out = stage(spark, d, SMOKE)
            assert out.dtypes == d.dtypes, name


def test_stages_on_odd_rows(spark):
    clean = " ".join(f"wort{i}" for i in range(80))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, clean, "en", "s", 1), (2, clean, "en", "s", 1),
            (None, clean.replace(" ", "\n"), None, None, None), (3, clean.upper() + " token=abcdefgh1", "en", None, 7), (4, "y " * 40_000, "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, SMOKE).collect()
    base_ok = [r for r in rows if not base_rules(r[1])[-1]]
    assert all(tuple(r) in rows and not base_rules(r["text"])[-1] for r in out["quality_rules"]) and len(base_ok) == 4
    # One of the two empty texts and one of the three copies (the smallest id) stay.
    assert sorted((r["doc_id"] or 0) for r in out["simhash_dedup"]) == [1, 2, 3, 4]
    assert len(out["decontaminate"]) == len(rows)
    red = [r for r in out["secret_scan"] if r["text"] and r["text"].endswith("[SECRET]")]
    assert len(out["secret_scan"]) == len(rows) and [(r["doc_id"], r["n_chars"]) for r in red] == [(3, len(red[0]["text"]))]
    assert len(out["sentencepiece"]) == len(rows) and all(r["round_trip"] for r in out["sentencepiece"] if r["ids"] is not None)
