import random

import pytest
from pyspark.sql import types as T

from riskframe.llm import license_scan
from riskframe.llm.license_texts import TEMPLATES, Template
from brute import BENCH_WORD, lower_ascii

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("key", T.StringType()), T.StructField("words", T.StringType()), T.StructField("h", T.LongType())])
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def report(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "k", "w", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in license_scan.license_report(df, **kw).collect()], key=str)


def brute(doc_id, text, templates=TEMPLATES, k=3):
    """One text against every template, all places compared with all places."""
    words = BENCH_WORD.findall(lower_ascii(text or ""))
    places, base, labels, score, n_spans = [], set(), set(), 0.0, 0
    for t in templates:
        own = BENCH_WORD.findall(lower_ascii(t.text))
        runs = len(own) - k + 1
        diagonals = {}
        for p in range(len(words) - k + 1):
            for q in range(runs):
                if words[p:p + k] == own[q:q + k]:
                    diagonals.setdefault(p - q, set()).add(q)
        kept = sorted(d for d, qs in diagonals.items() if len(qs) >= max(1, runs // 16))
        merged = []
        for d in kept:
            if merged and d - merged[-1][-1] <= len(own) // 4:
                merged[-1].append(d)
            else:
                merged.append([d])
        for ds in merged:
            whole = [d for d in ds if t.named and len(diagonals[d]) == runs]
            start, end = min(d + min(diagonals[d]) for d in ds), max(d + max(diagonals[d]) + k for d in ds)
            part = len({q + j for d in ds for q in diagonals[d] for j in range(k)}) / len(own)
            compact = end - start <= 1.5 * len(own)
            places += whole
            if whole:
                base.add(t.label)
            if whole or (compact and part >= t.share):
                labels.add(t.label)
                n_spans += 1
            if whole or compact:
                score = max(score, part)
    first, last = (min(places), max(places)) if places else (None, None)
    return doc_id, len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, n_spans


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at:at + rng.randrange(2)] = [rng.choice(["acme", "x", "Über", words[at]])]
    return " ".join(words)


def test_random_edits_against_all_places(spark):
    rng = random.Random(5)
    rows = []
    for n in range(120):
        parts = [edited(rng, rng.choice(TEMPLATES).text, rng.choice([0, 0, 1, 3, 12, 40])) for _ in range(rng.randrange(4))]
        noise = [" ".join(rng.choices(["the", "software", "of", "license", "cc", "by", "nc", "é", "MIT"], k=rng.randrange(30))) for _ in range(3)]
        both = parts + noise
        rng.shuffle(both)
        rows.append((n, rng.choice([" ", ". ", "\n"]).join(both)))
    assert report(spark, rows) == sorted([brute(*r) for r in rows], key=str)


def test_odd_rows(spark):
    long = "filler words and " * 30_000 + "Released under the MIT License. " + "more filler " * 20_000
    rows = [(1, None), (2, ""), (3, "cc by"), (4, "CC-BY-NC 4.0, cc by nc cc by nc"), (None, "under the MIT license"), (5, long),
            (6, "under the ＭＩＴ license"), (7, "under the K license"), (8, "...")] + [(9, "Apache License, Version 2.0")] * 5
    got = report(spark, rows)
    few = [r for r in rows if r[0] != 5]
    assert [g for g in got if g[0] != 5] == sorted([brute(*r) for r in few], key=str)
    assert next(g for g in got if g[0] == 5)[:8] == (5, 30_000 * 3 + 5 + 40_000, 1, 90_001, 90_001, "mit", "mit", 1.0)
    assert report(spark, []) == []


def test_planted_bodies_survive_edits(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for n, t in enumerate(x for x in TEMPLATES if x.share < 1):
        rows.append((n, "some words before " + edited(rng, t.text, 1) + " and behind"))
        want[n] = t.label
    for i, *_, labels, score, _ in report(spark, rows):
        assert want[i] in labels.split(",") and score >= 0.8


def test_phrases_are_the_stated_ones():
    assert {t.text: t.label for t in TEMPLATES if t.named} == PHRASES


def test_a_template_shorter_than_a_run_is_refused(spark):
    with pytest.raises(ValueError):
        report(spark, [(1, "a b c")], templates=[Template("x", "two words")])
