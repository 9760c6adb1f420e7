"""License scans by diagonal voting.

Every run of ``k`` words of every text is hashed and joined to the places of
the license templates that hold the same run. A hit at text word ``p`` and
template word ``q`` is a vote for the diagonal ``p - q``: an unchanged copy
puts all its votes on one diagonal, an edited one on a few close by. Votes
are aggregated as one bit per template word, diagonals with too few votes
for their template's length are noise, and neighbouring diagonals (at most a
quarter of the template apart) are merged into a span. A span is verified:
each vote's words are compared, not only their hashes; the template's words
that the span's votes cover are counted against the share that the template
asks for; and the span may be no longer than one and a half templates. A
named phrase stands wherever a diagonal has all of its votes.

All work is DataFrame expressions. The table of template places is broadcast:
its size is that of the given templates, whatever the corpus. Unmatched runs
end in the task that made them, and texts are not shuffled. Votes are kept
by a digest of the text; setting a bit twice changes nothing, so copies of a
text (a third of all rows, say) are combined before the shuffle and share
one result, which a plain join gives back to every row.

Words are runs of ASCII letters (A-Z in lower case), digits and non-ASCII
characters. Null and empty texts have no words, no labels and the score 0;
a text of fewer than ``k`` words likewise has no labels. Very long texts are
read whole. Repeated rows and rows without an id are rows of their own. An
empty table gives an empty result, and extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.llm.common import col, materialize
from riskframe.llm.license_texts import TEMPLATES, Template

GRAM_WORDS = 3
VOTE_PART = 16      # a diagonal needs one vote for each 16 runs of its template
SHIFT_PART = 4      # merged diagonals differ by at most a quarter of the template
LONGEST = 1.5       # a span's words to its template's

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_tables(spark: SparkSession, templates: list[Template], k: int) -> tuple[DataFrame, DataFrame, int]:
    """(places of every run of k words, one row a template, 64-bit parts that the longest template needs)."""
    places, rows, parts = [], [], 1
    for t, one in enumerate(templates):
        words = template_words(one.text)
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {one.text!r}")
        runs = len(words) - k + 1
        parts = max(parts, -(-len(words) // 64))
        rows.append((t, one.label, one.named, one.share, len(words), runs, max(1, runs // VOTE_PART), len(words) // SHIFT_PART))
        places += [(t, q, words[q:q + k]) for q in range(runs)]
    grams = spark.createDataFrame(places, "template int, q int, gram array<string>")
    return (grams.select("template", "q", "gram", F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(k)]).alias("h")),
            spark.createDataFrame(rows, "template int, label string, named boolean, share double, size int, runs int, "
                                        "least_votes int, shift int"), parts)


def votes(texts: DataFrame, grams: DataFrame, parts: int, k: int) -> DataFrame:
    """(key, template, diagonal, first, last, b0, b1, ...): the template places that each diagonal has, a bit each."""
    run = [F.get("words", F.col("p") + j) for j in range(k)]
    rows = (texts.select("key", "words", F.posexplode_outer("words").alias("p", "w"))
            .where(F.col("p") <= F.size("words") - k).withColumn("h", F.xxhash64(*run)))
    hit = rows.join(F.broadcast(grams), "h").where(F.slice("words", F.col("p") + 1, k) == F.col("gram"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q") % 64)
    part = F.floor(F.col("q") / 64)
    return hit.groupBy("key", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.min("q").alias("first"), F.max("q").alias("last"),
        *[F.coalesce(F.bit_or(F.when(part == n, bit)), F.lit(0).cast("long")).alias(f"b{n}") for n in range(parts)])


def covered_words(parts: int, k: int) -> Column:
    """How many template words the set places and the k - 1 words after each cover."""
    total = F.lit(0)
    for n in range(parts):
        bits = F.col(f"b{n}")
        for j in range(1, k):
            bits = bits.bitwiseOR(F.shiftleft(F.col(f"b{n}"), j))
            if n:
                bits = bits.bitwiseOR(F.shiftrightunsigned(F.col(f"b{n - 1}"), 64 - j))
        total = total + F.bit_count(bits)
    return total


def spans(texts: DataFrame, templates: list[Template], k: int) -> DataFrame:
    """The merged spans of every text, verified or not: (key, template, span, label, named, share, size, n_places,
    first_place, last_place, start, end, covered), with places of whole phrases and the span's first and end word."""
    grams, about, parts = template_tables(texts.sparkSession, templates, k)
    bits = [f"b{n}" for n in range(parts)]
    n_votes = sum((F.bit_count(b) for b in bits), F.lit(0))
    voted = (votes(texts, grams, parts, k).join(F.broadcast(about), "template")
             .withColumn("votes", n_votes).where(F.col("votes") >= F.col("least_votes")))
    by = W.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.col("shift"), F.lit(False))
    numbered = voted.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(by))
    whole = F.when(F.col("named") & (F.col("votes") == F.col("runs")), F.col("diagonal"))
    merged = numbered.groupBy("key", "template", "span").agg(
        *[F.first(c).alias(c) for c in ("label", "named", "share", "size")],
        F.count(whole).alias("n_places"), F.min(whole).alias("first_place"), F.max(whole).alias("last_place"),
        F.min(F.col("diagonal") + F.col("first")).alias("start"),
        F.max(F.col("diagonal") + F.col("last") + k).alias("end"), *[F.bit_or(b).alias(b) for b in bits])
    return merged.withColumn("covered", covered_words(parts, k)).drop(*bits)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   templates: list[Template] = TEMPLATES, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans): one row per document.

    ``n_base`` counts the places of named phrases, first and last are the smallest and largest of their starts;
    ``labels`` adds the templates of verified spans; ``score`` is the best span's share of its template."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary")))
    texts = docs.select(key.alias("key"), text_words(text).alias("words"))
    found = spans(texts, templates, gram_words)
    part = F.least(F.col("covered") / F.col("size"), F.lit(1.0))
    compact = F.col("end") - F.col("start") <= LONGEST * F.col("size")
    verified = (F.col("n_places") > 0) | (compact & (part >= F.col("share")))
    named = F.col("n_places") > 0

    def joined(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    by_text = found.groupBy("key").agg(
        F.sum("n_places").alias("n_base"), F.min("first_place").cast("long").alias("first_word"),
        F.max("last_place").cast("long").alias("last_word"), joined(F.when(named, F.col("label"))).alias("base_labels"),
        joined(F.when(verified, F.col("label"))).alias("labels"),
        F.max(F.when(compact | named, part)).alias("score"), F.count_if(verified).alias("n_spans"))
    by_text = materialize(by_text, "licenses")  # apart from its shuffle, so that Spark can split the join's hot keys
    rows = docs.select(col(id_col).alias("doc_id"), key.alias("key"), F.size(text_words(text)).cast("long").alias("n_words"))
    zero, none = F.lit(0).cast("long"), F.lit("")
    return rows.join(by_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_spans", zero).alias("n_spans"))
