"""Language identification by word-first backoff.

From the training rows come, per language, the log frequency of words and of
character n-grams of 4 to 1 characters (word ends marked). A word of a text
is scored by its word frequencies if any language knows it; if not, by the
mean over its n-grams of the longest length that is known in some place,
falling back to shorter ones at the places where none is. The language of
the highest mean score wins; ties go to the name that sorts first.

Words known to a language are those that make up at least ``WORD_SHARE`` of
its words, so one language has at most ``1 / WORD_SHARE`` of them whatever
the corpus; n-grams likewise. Every language of the training rows is kept,
however few rows it has: what is broadcast grows with the number of languages,
not with the rows. Only the kept frequencies are stored; full rows, with a
number per language, are made of ``CELLS`` numbers or of one text at a time.

Words are runs of letters, lower-cased. A text that is null or has no letter
is ``und`` with score 0; so is every text if there is no training row. The
score of others is the posterior of the winner under equal priors, at the
mean log score per word scaled by ``SHARPNESS``. Repeated rows are predicted
each for itself; extra columns pass through. Texts of any length are read
whole.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import TEXT_BLOCK_BYTES, blocks, col, free_name, materialize, utf8

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
EDGE = " "
WORD_SHARE = 2e-5
GRAM_SHARE = 2e-5
SHARPNESS = 4.0
UNDETERMINED = "und"
FLUSH_WORDS = 300_000
CACHED_WORDS = 300_000
CELLS = 1 << 23


def words_of(text: bytes) -> list[str]:
    """The lower-cased words; signs that are numbers only (such as a superscript two) are none."""
    words = WORD.findall(text.decode("utf-8", "replace").lower())
    return words if text.isascii() else [w for w in words if not w.isnumeric()]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"{EDGE}{word}{EDGE}" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n): counted inside each task, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            langs = [lang for lang, c in counts.items() for _ in c]
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array([w for c in counts.values() for w in c], pa.string()),
                 pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for block in blocks(v.as_py() for v in batch.column(0)):
                for text in block:
                    counts.setdefault(langs[at], Counter()).update(words_of(text or b""))
                    at += 1
                if sum(map(len, counts.values())) > FLUSH_WORDS:
                    yield flush()
                    counts = {}
        yield flush()

    parts = docs.select(utf8(text_col).alias("text"), col(lang_col).cast("string").alias("lang")).mapInArrow(
        count, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) of all n-gram lengths, from counted words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for size in range(1, LONGEST_GRAM + 1):
                    for g in grams_of(word, size):
                        counts[lang, g] += n
            if len(counts) > FLUSH_WORDS:
                yield _gram_batch(counts)
                counts = Counter()
        yield _gram_batch(counts)

    return words.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _gram_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in counts], pa.string()), pa.array([g for _, g in counts], pa.string()),
         pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])


def _frequent(counts: DataFrame, keys: list[str], item: str, share: float) -> DataFrame:
    """(lang, item, p): the items of at least ``share`` of their language's total."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    p = (F.col("n") / F.col("total")).alias("p")
    # One row per language (and n-gram length).
    return counts.join(F.broadcast(total), keys).where(F.col("n") >= share * F.col("total")).select("lang", item, p)


class SparseRows:
    """A matrix with a column per language that stores only the languages that know an item; others have ``rest``."""

    def __init__(self, begin: np.ndarray, lang: np.ndarray, value: np.ndarray, width: int, rest: float):
        self.begin, self.lang, self.value, self.width, self.rest = begin, lang, value, width, rest

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        size = self.begin[rows + 1] - self.begin[rows]
        out = np.full((len(rows), self.width), self.rest)
        at = np.arange(size.sum()) + np.repeat(self.begin[rows] - (np.cumsum(size) - size), size)
        out[np.repeat(np.arange(len(rows)), size), self.lang[at]] = self.value[at]
        return out


class LangModel:
    """Log frequencies: ``words`` and ``grams`` give the row of a word or n-gram in
    a matrix with a column per language; a language that does not know the
    item has the share below which none is kept."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rows: SparseRows | np.ndarray, grams: dict[str, int],
                 gram_rows: SparseRows | np.ndarray):
        self.langs, self.words, self.word_rows, self.grams, self.gram_rows = langs, words, word_rows, grams, gram_rows

    def backoff(self, word: str) -> list[int]:
        """The n-gram of each place of a word: the longest known one that ends there; places without any are left out."""
        get, marked, out = self.grams.get, f"{EDGE}{word}{EDGE}", []
        for i in range(1, len(marked) - 1):
            for start in range(max(0, i - LONGEST_GRAM + 1), i + 1):
                row = get(marked[start:i + 1])
                if row is not None:
                    out.append(row)
                    break
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log score per language of each word: its own, else the mean over its n-grams (0 without any)."""
        out = np.zeros((len(words), len(self.langs)))
        known = [(i, self.words[w]) for i, w in enumerate(words) if w in self.words]
        if known:
            at, rows = np.array(known).T
            out[at] = self.word_rows[rows]
        new = [(i, g) for i, w in enumerate(words) if w not in self.words and (g := self.backoff(w))]
        size = np.array([len(g) for _, g in new], np.int64)
        part = np.cumsum(size) * len(self.langs) // CELLS
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            rows = self.gram_rows[np.concatenate([new[i][1] for i in at])]
            out[[new[i][0] for i in at]] = np.add.reduceat(rows, np.cumsum(size[at]) - size[at], axis=0) / size[at, None]
        return out


def fit(docs: DataFrame, text_col: str, lang_col: str) -> LangModel:
    """Fits on all rows of ``docs`` with a language. The driver gets the kept words and n-grams only."""
    rows = docs.where(col(lang_col).isNotNull())
    words = materialize(word_counts(rows, text_col, lang_col), "words")
    langs = sorted(r["lang"] for r in rows.select(col(lang_col).cast("string").alias("lang")).distinct().collect())
    grams = gram_counts(words).withColumn("size", F.length("gram"))
    return LangModel(langs, *_table(_frequent(words, ["lang"], "word", WORD_SHARE), "word", langs, WORD_SHARE),
                     *_table(_frequent(grams, ["lang", "size"], "gram", GRAM_SHARE), "gram", langs, GRAM_SHARE))


def _table(rows: DataFrame, item: str, langs: list[str], share: float) -> tuple[dict[str, int], SparseRows]:
    at = {lang: i for i, lang in enumerate(langs)}
    number: dict[str, int] = {}
    row, lang, p = array("q"), array("q"), array("d")
    for r in rows.toLocalIterator():
        row.append(number.setdefault(r[item], len(number)))
        lang.append(at[r["lang"]])
        p.append(r["p"])
    row = np.array(row, np.int64)
    order = np.argsort(row, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(number)))])
    return number, SparseRows(begin, np.array(lang, np.int32)[order], np.log(np.array(p))[order], len(langs), np.log(share / 2))


class TextScorer:
    """Predicts texts with a bounded cache of word scores."""

    def __init__(self, model: LangModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.matrix = np.zeros((0, len(self.model.langs)))

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        if len(self.number) > min(CACHED_WORDS, CELLS // max(len(self.model.langs), 1)):
            self.reset()
        split = [words_of(t) if t else [] for t in texts]
        new = [w for w in set().union(*split) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.matrix), len(self.matrix) + len(new)), strict=True))
            self.matrix = np.concatenate([self.matrix, self.model.word_scores(new)])
        out = []
        for words in split:
            if not words or not self.model.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            mean = self.matrix[ids].mean(axis=0)
            best = int(mean.argmax())
            out.append((self.model.langs[best], float(1.0 / np.exp(SHARPNESS * (mean - mean[best])).sum())))
        return out


def predict(docs: DataFrame, model: LangModel, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct ``out_col`` (lang, score). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the shares kept of each language

    limit = min(TEXT_BLOCK_BYTES, CELLS // max(len(model.langs), 1))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = TextScorer(LangModel(**shared.value))
        for batch in batches:
            rows = [r for block in blocks((v.as_py() for v in batch), limit) for r in scorer.predict(block)]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.float64())], names=["lang", "score"])

    return docs.withColumn(out_col, F.arrow_udf(run, "lang string, score double")(utf8(text_col)))


def language_report(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents, fitted on those that ``held_out`` (a column) leaves."""
    model = fit(docs.where(~held_out), text_col, lang_col)
    out = free_name(docs, "_language")
    return predict(docs, model, text_col, out).select(
        col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(f"{out}.lang").alias("lang_pred"),
        F.col(f"{out}.score").alias("score"))
