"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a fixed vector of transformed statistics. Per class the
mean and covariance are sums over the labelled rows, added up by Spark; each
covariance is shrunk towards the pooled one and then towards its diagonal.
The score is the logistic function of the difference of the two Gaussian log
densities (Mahalanobis distances by Cholesky factors that are computed once)
plus the log ratio of the class sizes.

Null and empty texts have the vector of a text without words and a score like
any other. A document labelled more than once counts with its highest label,
and a document id that repeats counts with every row. A class without rows
makes every score the share of label 1 (0.5 without any label). An empty table
gives an empty result. Extra columns
pass through; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.byte_runs import RunHasher, byte_values, joined, mix, repeats, runs
from riskframe.llm.common import blocks, col, free_name, materialize, utf8

THRESHOLD = 0.7
POOLED_SHARE = 0.3
DIAGONAL_SHARE = 0.1
FLOOR = 1e-3
BLOCK_BYTES = 1 << 19

FEATURES = ("log_words", "log_mean_word", "log_line", "upper", "digit", "symbol", "punct", "non_ascii", "stop_like",
            "repeat_window", "repeat_word", "short_line", "word_spread", "odd_end", "repeat_line")


def _mask(test) -> np.ndarray:
    return np.array([bool(test(c)) for c in range(256)])


class Statistics:
    """Transformed statistics of a block of texts, a row for each."""

    def __init__(self):
        self.hasher, self.value = RunHasher(), byte_values()
        self.word = _mask(lambda c: c not in b" \t\n\x0b\x0c\r")
        self.upper = _mask(lambda c: 0x41 <= c <= 0x5A)
        self.digit = _mask(lambda c: 0x30 <= c <= 0x39)
        self.symbol = _mask(lambda c: c in b"#*$%&|<>@^~{}[]\\_=+")
        self.punct = _mask(lambda c: c in b".,;:!?'\"()-")
        self.high = _mask(lambda c: c >= 0x80)
        self.alnum = _mask(lambda c: c >= 0x80 or chr(c).isalnum())

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        data, begin = joined(texts)
        n, number = np.diff(begin, append=len(data)) - 1, len(texts)
        per = lambda mask: np.add.reduceat(mask[data].astype(np.int64), begin)
        word = self.word[data]
        start, end = runs(word.astype(np.uint8))
        owner = np.searchsorted(begin, start, side="right") - 1
        words = np.bincount(owner, minlength=number)
        size = end - start
        chars = np.bincount(owner, weights=size, minlength=number)
        squares = np.bincount(owner, weights=size.astype(float) ** 2, minlength=number)
        w = np.maximum(words, 1)
        spread = np.sqrt(np.maximum(squares / w - (chars / w) ** 2, 0))
        hashed = self.hasher.hashes(self.hasher.sums(self.value[data]), start, end)
        keyed = mix(hashed + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, seen = repeats(keyed)
        again = np.bincount(owner[seen], minlength=number)
        whole = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else owner[:0]
        window = mix(mix(keyed[whole]) + mix(keyed[whole + 1] * np.uint64(3)) + keyed[whole + 2])
        _, twice = repeats(window)
        windows = np.bincount(owner[whole[twice]], minlength=number)
        short = np.bincount(owner[size <= 3], minlength=number)
        odd = np.bincount(owner[~self.alnum[data[end - 1]] & ~self.punct[data[end - 1]]] if len(end) else owner,
                          minlength=number)
        line_end = np.flatnonzero(data == 0x0A)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
        before = np.concatenate([[0], np.cumsum(word)])
        filled = before[line_end] > before[line_start]
        line_owner = np.searchsorted(begin, line_start[filled], side="right") - 1
        lines = np.maximum(np.bincount(line_owner, minlength=number), 1)
        tight = np.bincount(line_owner[(line_end - line_start)[filled] < 30], minlength=number)
        line_hash = self.hasher.hashes(self.hasher.sums(self.value[data]), line_start[filled], line_end[filled])
        _, line_again = repeats(mix(line_hash + line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        share = lambda a, b: np.log((a + 0.5) / (np.maximum(b - a, 0) + 0.5))  # noqa: E731  a smoothed logit
        return np.stack([
            np.log1p(words), np.log1p(chars / w), np.log1p(n / lines), share(per(self.upper), n),
            share(per(self.digit), n), share(per(self.symbol), n), share(per(self.punct), n), share(per(self.high), n),
            share(short, words), share(windows, np.maximum(words - 2, 0)), share(again, words), share(tight, lines),
            np.log1p(spread), share(odd, words), share(np.bincount(line_owner[line_again], minlength=number), lines)], axis=1)


def with_statistics(docs: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """``docs`` with an array ``out_col`` of the statistics in the order of FEATURES. No shuffle."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stats, width = Statistics(), len(FEATURES)
        for batch in batches:
            parts = [np.zeros((0, width))] + [stats([t or b"" for t in block])
                                              for block in blocks((v.as_py() for v in batch), BLOCK_BYTES)]
            rows = np.concatenate(parts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))

    return docs.withColumn(out_col, F.arrow_udf(run, "array<double>")(utf8(text_col)))


class Discriminant(NamedTuple):
    """Class means and inverse Cholesky factors, or None, with the log density offset."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    offset: float


def fit(rows: DataFrame, stats_col: str, label_col: str) -> Discriminant:
    """Fits on all rows. Sums and products are added up by class; two rows come to the driver."""
    d = len(FEATURES)
    x = [F.element_at(F.col(stats_col), i + 1) for i in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    got = {r["y"]: r for r in rows.groupBy(F.col(label_col).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), *sums, *products).collect() if r["y"] in (0, 1)}
    n = {y: got[y]["n"] if y in got else 0 for y in (0, 1)}
    if min(n.values()) == 0:
        share = n[1] / sum(n.values()) if sum(n.values()) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Discriminant(None, None, float(np.log(share / (1 - share))))
    means, covs = [], []
    for y in (0, 1):
        mean = np.array([got[y][f"s{i}"] for i in range(d)]) / n[y]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                second[i, j] = second[j, i] = got[y][f"p{i}_{j}"] / n[y]
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    whiten, log_det = [], []
    for c in covs:
        c = (1 - POOLED_SHARE) * c + POOLED_SHARE * pooled
        c = (1 - DIAGONAL_SHARE) * c + DIAGONAL_SHARE * np.diag(np.diag(c)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(whiten), float(np.log(n[1] / n[0]) + (log_det[0] - log_det[1]) / 2))


def scores(stats: np.ndarray, model: Discriminant) -> np.ndarray:
    """The probability of label 1 for each row of statistics."""
    margin = np.full(len(stats), model.offset)
    if model.means is not None:
        far = [(((stats - m) @ w.T) ** 2).sum(axis=1) for m, w in zip(model.means, model.whiten, strict=True)]
        margin += (far[0] - far[1]) / 2
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def with_score(rows: DataFrame, model: Discriminant, stats_col: str = "stats", out_col: str = "score") -> DataFrame:
    """``rows`` with the score of their statistics."""
    fields = tuple(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = Discriminant(*fields)
        for batch in batches:
            x = np.asarray(batch.flatten(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.array(scores(x, fitted))

    return rows.withColumn(out_col, F.arrow_udf(run, "double")(F.col(stats_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; labels of rows that
    ``held_out`` (a column over ``doc_id``) marks are not used. Texts are read once."""
    rows = materialize(with_statistics(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", "stats")
                       .select("doc_id", "stats", held_out.alias("held_out")), "statistics")
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = fit(rows.where(~F.col("held_out")).join(known, "doc_id"), "stats", "label")
    return with_score(rows, model).select("doc_id", "held_out", "score",
                                          F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
