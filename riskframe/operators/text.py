"""Text retrieval (R-1..R-3, R-7, J-4, K-2): sentence chunking with overlap,
TF-IDF fitting as long tables, and exact many-query cosine search.

TF-IDF is kept in long form ``(doc, term, weight)``: a document's term counts
are taken where it lies, document frequencies by ``groupBy(term)``, L2 norms
by a per-document sum.

A search scores no pair that cannot reach the top k (MaxScore, as joins):

* documents are put into classes by the power of two of their number of
  terms, and each term of a query has an upper bound per class: its query
  weight times the largest document weight of that term and class;
* a query's threshold is the k-th best score among its champions, the
  documents with the largest weights of its terms, which are scored first;
* within a class the terms with the smallest bounds, as long as their sum
  stays below the threshold, are left out: a document that has none of the
  others is never met;
* of the documents met, those whose partial score and the left-out bounds
  together stay below the threshold are dropped, and only the rest are scored
  with all terms.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import written

LEFT_OUT_SHARE = 0.5  # of the threshold; the bounds of left-out terms add up to less
FREQUENT_SHARE = 0.001  # of the documents; more frequent terms are weighed where they lie
PIECE_WORDS = 128  # of a text that reach Python at once
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
SENTENCE_SPLIT = r"(?<=[.!?])\s+"


# Spark ML's default English stop list, in its own order.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())


def english_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop list."""
    return ENGLISH_STOP_WORDS


def tokens(text) -> Column:
    """Lower-cased tokens of two or more Unicode word characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_RE), 0)


def chunk_spans(counts: list[int], chunk_size: int, overlap: int) -> list[tuple[int, int]]:
    """Sentence ranges of the chunks, from the sentences' word counts.

    Sentences are packed while they hold at most ``chunk_size`` words; the
    next chunk starts with the longest run of the last sentences that holds
    at most ``overlap`` words. A longer sentence stays whole. One pass: the
    start of a run is found by bisection in the running totals.
    """
    total = list(accumulate(counts, initial=0))
    start, out = 0, []
    for i in range(len(counts)):
        if i > start and total[i + 1] - total[start] > chunk_size:
            out.append((start, i))
            start = bisect_left(total, total[i] - overlap, start, i)
    if counts:
        out.append((start, len(counts)))
    return out


def chunk_documents(df: DataFrame, doc_id: str, text: str, source: str | None = None,
                    chunk_size: int = 400, overlap: int = 100) -> DataFrame:
    """(doc_id, [source,] chunk_no, text, word_count): one row per chunk.

    Sentences split after . ! ? + whitespace (blank ones skipped); see
    ``chunk_spans`` for the packing rule. Each document is cut on its own in
    one linear pass of an Arrow batch function; no shuffle.
    """
    split = re.compile(SENTENCE_SPLIT)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for value in batch:
                sents = [x for x in (y.strip() for y in split.split(value.as_py() or "")) if x]
                counts = [len(x.split()) for x in sents]
                rows.append([{"text": " ".join(sents[a:b]), "word_count": sum(counts[a:b])}
                             for a, b in chunk_spans(counts, chunk_size, overlap)])
            yield pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("word_count", pa.int32())])))

    cols = [doc_id] + ([source] if source else [])
    chunks = F.arrow_udf(run, "array<struct<text string, word_count int>>")(F.col(text))
    c = df.select(*cols, chunks.alias("_c")).select(*cols, F.posexplode("_c").alias("chunk_no", "_x"))
    return c.select(*cols, "chunk_no", F.col("_x.text").alias("text"), F.col("_x.word_count").alias("word_count"))


def term_counts(df: DataFrame, doc_id: str, text: str, stop_words=None) -> DataFrame:
    """(doc_id, term, tf) raw term frequencies without stop words."""
    stop = list(english_stop_words() if stop_words is None else stop_words)
    toks = df.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(text)).alias("term"))
    if stop:
        toks = toks.where(~F.col("term").isin(*stop))
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_transform(queries: DataFrame, query_id: str, text: str, vocab: DataFrame, stop_words=None) -> DataFrame:
    """Query vectors with the fitted vocabulary; unseen terms are ignored."""
    tf = term_counts(queries, query_id, text, stop_words).withColumnRenamed("doc_id", "query_id")
    w = tf.join(vocab, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return w.join(norm, "query_id").select("query_id", "term", (F.col("w") / F.col("_norm")).alias("qweight"))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows ranked 1..k per group by ``order``.

    Spark keeps the first k rows of a group in each task before the shuffle,
    so a group of millions of candidates is never gathered.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def local_term_counts(df: DataFrame, doc_id: str, text: str, stop_words=None, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(doc_id, n_terms, term, tf): the term counts of each row's text, taken in its own task. No shuffle.

    A text reaches Python in pieces of at most ``piece_words`` words, so a batch
    of rows holds a bounded number of words, however long the texts are. The
    last text of a batch may go on in the next one: its counts stay open, a
    number for each of its terms.
    """
    stop = frozenset(english_stop_words() if stop_words is None else stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_terms", "term", "tf"]
        open_id, open_tf = None, {}

        def finished() -> pa.RecordBatch:
            n = len(open_tf)
            return pa.RecordBatch.from_arrays(
                [open_id.take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, n)), pa.array(list(open_tf), pa.string()),
                 pa.array(list(open_tf.values()), pa.int64())], names=names)

        for batch in batches:
            if not len(batch):
                continue
            starts, values = batch.column("piece").to_numpy() == 0, batch.column("words")
            heads, coded = batch.column("doc_id").take(pa.array(np.flatnonzero(starts))), values.flatten().dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy()
            row = np.repeat(np.cumsum(starts), values.value_lengths().to_numpy())  # 0: the open text
            if stop and len(words):
                kept = ~np.fromiter((w in stop for w in words.to_pylist()), bool, len(words))[code]
                row, code = row[kept], code[kept]
            place, tf = np.unique(row * (len(words) + 1) + code, return_counts=True)
            row, code = np.divmod(place, len(words) + 1)

            def add(begin: int, end: int) -> None:
                for w, n in zip(words.take(pa.array(code[begin:end])).to_pylist(), tf[begin:end].tolist(), strict=True):
                    open_tf[w] = open_tf.get(w, 0) + n

            first, last = np.searchsorted(row, [1, max(len(heads), 1)])
            add(0, first)
            if not len(heads):
                continue
            if open_tf:
                yield finished()
            if last > first:
                whole, code_of, tf_of = row[first:last] - 1, code[first:last], tf[first:last]
                terms = np.bincount(whole, minlength=len(heads))
                yield pa.RecordBatch.from_arrays([heads.take(pa.array(whole)), pa.array(terms[whole]), words.take(pa.array(code_of)),
                                                  pa.array(tf_of)], names=names)
            open_id, open_tf = heads.slice(len(heads) - 1), {}
            add(last, len(row))
        if open_tf:
            yield finished()

    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), tokens(F.coalesce(text, F.lit(""))).alias("words"))
    last_piece = F.floor((F.greatest(F.size("words"), F.lit(1)) - 1) / piece_words).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last_piece), lambda n: F.slice("words", n * piece_words + 1, F.lit(piece_words)))
    return (rows.select("doc_id", F.posexplode(pieces).alias("piece", "words"))
            .mapInArrow(run, f"doc_id {kind}, n_terms long, term string, tf long"))


def document_frequencies(tf: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, idf, frequent) as a written table: idf = ln((1 + n) / (1 + df)) + 1, and whether
    more than FREQUENT_SHARE of the documents have the term."""
    n = corpus.agg(F.count(F.lit(1)).alias("_n"))
    return written(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                   .join(F.broadcast(n), how="cross")  # n: one global row
                   .select("term", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
                           (F.col("df") > FREQUENT_SHARE * F.col("_n")).alias("frequent")), "vocabulary")


def frequent_terms(known: DataFrame) -> DataFrame:
    """The frequent terms, to be broadcast: documents of t terms on average leave room for
    t / FREQUENT_SHARE of them, whatever the corpus."""
    return F.broadcast(known.where("frequent").drop("frequent"))


def rare_rows(tf: DataFrame, known: DataFrame) -> DataFrame:
    """``tf`` of the other terms, joined by term: the only rows that move for their idf."""
    return tf.join(frequent_terms(known), "term", "left_anti").join(known.where("NOT frequent").drop("frequent"), "term")


def tfidf_fit(corpus: DataFrame, doc_id: str, text: str, stop_words=None) -> tuple[DataFrame, DataFrame]:
    """Fit TF-IDF on ``corpus``, whose ids are unique.

    Returns (weights(doc_id, term, weight) L2-normalised per document,
    vocab(term, idf)) with idf = ln((1 + n) / (1 + df)) + 1 and raw tf. The
    weights are shuffled once, by document.
    """
    tf = written(local_term_counts(corpus, doc_id, text, stop_words).drop("n_terms"), "terms")
    known = document_frequencies(tf, corpus)
    rows = tf.join(frequent_terms(known), "term").unionByName(rare_rows(tf, known))
    w = rows.select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))  # one document's terms
    return w.select("doc_id", "term", (F.col("w") / norm).alias("weight")), known.select("term", "idf")


class Scored(NamedTuple):
    found: DataFrame      # query_id, rank, doc_id, score
    scored: DataFrame     # query_id, n: how many documents were scored with all terms


def pruned_search(corpus: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str,
                  top_k: int = 3, min_score: float = 0.05, stop_words=None, left_out_share: float = LEFT_OUT_SHARE) -> Scored:
    """The search of ``tfidf_search`` with unrounded scores, and how many documents each query scored."""
    tf = written(local_term_counts(corpus, doc_id, text, stop_words)
                 .withColumn("class", F.floor(F.log2("n_terms")).cast("int")).drop("n_terms"), "terms")
    vocab = document_frequencies(tf, corpus)
    asked = written(tfidf_transform(queries, query_id, query_text, vocab.select("term", "idf"), stop_words), "query_terms")
    known = written(vocab.join(asked.select("term").distinct().withColumn("wanted", F.lit(True)), "term", "left")
                    .withColumn("wanted", F.coalesce("wanted", F.lit(False))), "known_terms")
    rare = written(rare_rows(tf, known), "rare_terms")
    w = F.col("tf") * F.col("idf")
    weighed = tf.join(frequent_terms(known), "term").unionByName(rare)
    norm = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    postings = written(weighed.where("wanted").select("term", "doc_id", "class", w.alias("w")).join(norm, "doc_id")
                       .select("term", "doc_id", "class", (F.col("w") / F.col("norm")).alias("weight")), "postings")
    slack = 1.0 - 1e-9  # neither rounding nor a tie at nine digits may cost a document

    def kth(scores: DataFrame) -> DataFrame:
        """(query_id, floor): each query's k-th best score so far."""
        best = top_k_per_group(scores, ["query_id"], [F.col("score").desc()], top_k)
        return best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= top_k, F.min("score")).alias("floor"))

    def all_terms(pairs: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the pairs, over every term they share."""
        return (pairs.select("query_id", "doc_id").join(asked, "query_id").join(postings, ["doc_id", "term"])
                .groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qweight")).alias("score")))

    champions = top_k_per_group(postings, ["term"], [F.col("weight").desc(), F.col("doc_id")], top_k)
    lower = (champions.join(asked, "term").groupBy("query_id", "doc_id")
             .agg(F.sum(F.col("weight") * F.col("qweight")).alias("score")))
    first = top_k_per_group(lower, ["query_id"], [F.col("score").desc(), F.col("doc_id")], 4 * top_k)
    floors = kth(all_terms(first))
    tops = postings.groupBy("term", "class").agg(F.max("weight").alias("top"))
    bounds = asked.join(tops, "term").join(floors, "query_id", "left").select(
        "query_id", "term", "class", "qweight", (F.col("qweight") * F.col("top")).alias("bound"),
        (F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(float(min_score))) * slack - 2e-9).alias("floor"))
    rising = Window.partitionBy("query_id", "class").orderBy("bound", "term")  # a row a term of the query
    bounds = written(bounds.withColumn("left_out", F.sum("bound").over(rising) < left_out_share * F.col("floor")), "bounds")
    unmet = F.when(F.col("left_out"), F.col("bound")).otherwise(0.0)
    unmet_square = F.when(F.col("left_out"), F.col("qweight") * F.col("qweight")).otherwise(0.0)
    rest = bounds.groupBy("query_id", "class").agg(F.sum(unmet).alias("rest"), F.sqrt(F.sum(unmet_square)).alias("rest_norm"),
                                                   F.first("floor").alias("floor"))
    met = (bounds.where("NOT left_out").select("query_id", "term", "class", "qweight").join(postings, ["term", "class"])
           .groupBy("query_id", "doc_id", "class").agg(F.sum(F.col("weight") * F.col("qweight")).alias("part"),
                                                       F.sum(F.col("weight") * F.col("weight")).alias("seen")))
    # What the left-out terms can add: their bounds, and their norm times that of the document's other weights.
    more = F.least("rest", F.col("rest_norm") * F.sqrt(F.greatest(1 - F.col("seen"), F.lit(0.0)) + 1e-9))
    kept = written(met.join(rest, ["query_id", "class"]).where(F.col("part") + more >= F.col("floor"))
                   .select("query_id", "doc_id"), "candidates")
    scores = all_terms(kept)
    top = top_k_per_group(scores, ["query_id"], [F.round("score", 9).desc(), F.col("doc_id").desc()], top_k)
    return Scored(top.where(F.col("score") > min_score).select("query_id", "rank", "doc_id", "score"),
                  kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))


def tfidf_search(corpus: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str,
                 top_k: int = 3, min_score: float = 0.05, stop_words=None) -> DataFrame:
    """(query_id, rank, doc_id, score 4 dp) for the top ``top_k`` documents per query.

    Cosine = sum over shared terms of query weight x document weight. Ranks
    by score (rounded to 9 dp) desc, then higher document id (as the
    reference's reversed argsort does); keeps score > ``min_score``. Ids are
    unique in both tables; a null text has no terms. A term of very many
    documents is split by Spark's skew join.
    """
    got = pruned_search(corpus, doc_id, text, queries, query_id, query_text, top_k, min_score, stop_words).found
    return got.select(F.col("query_id").alias(query_id), "rank", F.col("doc_id").alias(doc_id), F.round("score", 4).alias("score"))


def index_stats(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Document count, chunk count and status of a chunk index."""
    return chunks.agg(F.count_distinct(source).alias("documents"), F.count(F.lit(1)).alias("chunks")).select(
        F.col("documents").cast("long"), F.col("chunks").cast("long"),
        F.when(F.col("chunks") > 0, "READY").otherwise("EMPTY").alias("status"))
