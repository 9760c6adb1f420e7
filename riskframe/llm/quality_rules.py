"""Quality rules: base counts and a hashed n-gram likelihood ratio.

Two multinomials over hashed 1- and 2-grams are counted: one over the trusted
target documents, one over every document of the raw corpus. A text's score
is the mean of log(p_target / p_raw) over all its n-grams (length-normalised).
A document is kept if it passes the base rules and its score is at least
``threshold``: the verdict depends on the text and the two models alone.

Tokens are the runs of letters, digits and non-ASCII characters of a
lower-cased word and the runs of its other characters. Each task adds up its
buckets before the shuffle, so what moves is at most ``buckets`` rows a task;
the model is one number a bucket.

Null and empty texts have no words and fail the base rules. Repeated rows are
scored each for itself. An empty corpus or an empty target gives every text
the score 0. Extra columns pass through; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.byte_runs import POLY, RunHasher, byte_values, equal_entries, joined, mix, repeats, runs
from riskframe.llm.common import blocks, col, free_name, utf8

# Fixed values of the base rules.
WHITE_SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW_WORDS = 3

BUCKETS = 1 << 16
SMOOTHING = 1.0
THRESHOLD = -0.5

RULES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "base_failed boolean, llr double, kept boolean")
BLOCK_BYTES = 1 << 19


def _table(values: dict[bytes, int], rest: int, kind=np.uint8) -> np.ndarray:
    out = np.full(256, rest, kind)
    for chars, value in values.items():
        out[list(chars)] = value
    return out


UPPER = bytes(range(0x41, 0x5B))
ALNUM = bytes(range(0x30, 0x3A)) + UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
CONTINUED = bytes(range(0x80, 0xC0))  # all but the first byte of a character


class TextStats:
    """Counts, tokens and n-gram buckets of a block of texts at a time."""

    def __init__(self, buckets: int):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.mask = np.uint64(buckets - 1)
        self.hasher = RunHasher()
        self.token_kind = _table({WHITE_SPACE: 0, ALNUM: 1}, 2)
        self.word = _table({WHITE_SPACE: 0}, 1)
        self.word_char = _table({WHITE_SPACE: 0, CONTINUED: 0}, 1, np.int64)
        self.symbol = _table({SYMBOLS: 1}, 0, np.int64)
        self.value = byte_values()
        self.folded = self.value.copy()
        self.folded[list(UPPER)] = self.value[[c + 0x20 for c in UPPER]]

    def ngrams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bucket and the text number of every 1- and 2-gram, each text's in order."""
        data, begin = joined(texts)
        start, end = runs(self.token_kind[data])
        token = self.hasher.hashes(self.hasher.sums(self.folded[data]), start, end)
        owner = np.searchsorted(begin, start, side="right") - 1
        pair = mix(token[:-1] + mix(token[1:] + np.uint64(POLY)))
        inside = owner[1:] == owner[:-1]
        return (np.concatenate([token, pair[inside]]) & self.mask).astype(np.int64), np.concatenate([owner, owner[1:][inside]])

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: a column for each text."""
        data, begin = joined(texts)
        number = len(texts)
        word = self.word[data]
        sums = self.hasher.sums(self.value[data])
        start, end = runs(word)
        owner = np.searchsorted(begin, start, side="right") - 1
        hashed = self.hasher.hashes(sums, start, end)
        # Windows of words inside one text, and where two of them are equal.
        k = WINDOW_WORDS
        whole = np.flatnonzero(owner[k - 1:] == owner[:len(owner) - k + 1]) if len(owner) >= k else owner[:0]
        window = owner[whole].astype(np.uint64)
        for j in range(k):
            window = mix(window + np.uint64(POLY)) + hashed[whole + j]
        twice, _ = repeats(window)
        # Equal hashes are only candidates: their bytes are compared.
        raw, at = data.tobytes(), whole[twice]
        held = [[raw[a:b] for a, b in zip(start[at + j].tolist(), end[at + j].tolist(), strict=True)] for j in range(k)]
        same, _ = equal_entries(zip(owner[at].tolist(), *held, strict=True))
        covered = np.zeros(len(owner), bool)
        for j in range(k):
            covered[at[same] + j] = True
        # Lines with a word, and those equal to an earlier one of the text.
        line_end = np.flatnonzero(data == 0x0A)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
        words_before = np.concatenate([[0], np.cumsum(word, dtype=np.int64)])
        filled = words_before[line_end] > words_before[line_start]
        line_start, line_end = line_start[filled], line_end[filled]
        line_owner = np.searchsorted(begin, line_start, side="right") - 1
        line = mix(line_owner.astype(np.uint64) + np.uint64(POLY)) + self.hasher.hashes(sums, line_start, line_end)
        some, _ = repeats(line)
        at = np.flatnonzero(some)
        _, later = equal_entries((o, raw[a:b]) for o, a, b in zip(line_owner[at].tolist(), line_start[at].tolist(),
                                                                   line_end[at].tolist(), strict=True))
        again = at[later]
        return np.stack([
            np.bincount(owner, minlength=number), np.add.reduceat(self.word_char[data], begin),
            np.add.reduceat(self.symbol[data], begin), np.bincount(line_owner[again], minlength=number),
            np.bincount(owner[covered], minlength=number)])


def ngram_counts(docs: DataFrame, text_col: str, target_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents and of those marked in ``target_col``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = TextStats(buckets)
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted, at = np.asarray(batch.column(1).to_pylist(), bool), 0
            for block in blocks((v.as_py() for v in batch.column(0)), BLOCK_BYTES):
                bucket, owner = stats.ngrams([t or b"" for t in block])
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[trusted[at:at + len(block)][owner]], minlength=buckets)
                at += len(block)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                                         names=["bucket", "raw", "target"])

    parts = docs.select(utf8(text_col).alias("text"), col(target_col).alias("trusted")).mapInArrow(
        count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit_ratio(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(p_target / p_raw) of every bucket; zeros where either model is empty. Brings one row a bucket to the driver."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.toLocalIterator():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not raw.sum() or not target.sum():
        return np.zeros(buckets, np.float64)
    smooth = [(x + smoothing) / (x.sum() + smoothing * buckets) for x in (target, raw)]
    return np.log(smooth[0]) - np.log(smooth[1])


def mark_target(docs: DataFrame, labels: DataFrame, id_col: str, out_col: str) -> DataFrame:
    """``docs`` with a boolean: its id has a label of quality 1. A plain equi-join, so the trusted set may have any size."""
    key = free_name(docs, "_trusted_id")
    trusted = (labels.where(F.col("quality") == 1).select(F.col("doc_id").alias(key)).dropna().distinct()
               .withColumn(out_col, F.lit(True)))
    # Sorted on both sides at every size: the trusted set grows with the labels and is never broadcast.
    marked = docs.hint("merge").join(trusted, col(id_col) == F.col(key), "left").drop(key)
    return marked.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(False)))


def apply_rules(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", out_col: str = "rules",
                threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct ``out_col`` of the counts, the score ``llr`` and the verdict. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # one number a bucket

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        stats = TextStats(len(table))
        for batch in batches:
            parts = [np.zeros((6, 0))]
            for block in blocks((v.as_py() for v in batch), BLOCK_BYTES):
                texts = [t or b"" for t in block]
                bucket, owner = stats.ngrams(texts)
                total = np.bincount(owner, weights=table[bucket], minlength=len(texts))
                mean = total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
                parts.append(np.concatenate([stats.counts(texts), mean[None]]))
            got = np.concatenate(parts, axis=1)
            counts, llr = got[:5].astype(np.int64), got[5]
            failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_PERCENT * counts[0])
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
            yield pa.StructArray.from_arrays(
                [pa.array(c) for c in (*counts, failed, llr, ~failed & (llr >= threshold))], names=names)

    return docs.withColumn(out_col, F.arrow_udf(run, RULES)(utf8(text_col)))


def with_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       out_col: str = "rules", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Both models over ``docs`` (target: labels of quality 1), then every document's counts and verdict."""
    flag = free_name(docs, "_trusted")
    texts = docs.select(col(id_col), col(text_col)) if id_col != text_col else docs.select(col(id_col))
    counts = ngram_counts(mark_target(texts, labels, id_col, flag), text_col, flag, buckets)
    return apply_rules(docs, fit_ratio(counts, buckets), text_col, out_col, threshold)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: its id, the base counts, base_failed, kept and the score."""
    out = free_name(docs, "_rules")
    d = with_quality_rules(docs, labels, id_col, text_col, out, **kw)
    return d.select(col(id_col).alias("doc_id"), f"{out}.n_words", f"{out}.word_chars", f"{out}.n_symbols",
                    f"{out}.n_dup_lines", f"{out}.n_repeat_words", f"{out}.base_failed", f"{out}.kept", f"{out}.llr")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns."""
    out = free_name(docs, "_rules")
    d = with_quality_rules(docs, labels, id_col, text_col, out, **kw)
    return d.where(F.col(f"{out}.kept")).drop(out)
