"""Spelling variant grouping by permuterm rotations.

A word ``ab`` with a terminator has the rotations ``b$a``. Two words that
differ by a replaced letter, ``a x b`` and ``a y b``, have rotations ``b$a x``
and ``b$a y`` that differ in the last letter alone, and a word ``ab`` has a
rotation ``b$a`` that is the same with no letter behind. So every rotation is
written twice, whole and without its last letter, and the rows that share a
prefix are brought together and sorted; a scan over the sorted rows finds
each group of neighbours as one range. Among equal letters in a row only the
first counts as the deleted one, so every pair of neighbours meets in exactly
one group.

A group holds a row for each letter of the alphabet and one more at most. The
scan sends no pairs: each row gets how many neighbours its group gives it and
the best of them, from the group's counts and its two best members; these are
added up by word. Forms point from a word to its best neighbour if that is
several times as frequent, so chains are short and have no loops; roots are
found by pointer doubling, each round written to the shared folder.

Words are numbered in code-point order, and rows carry numbers. A prefix of
more than ``TEXT_LETTERS`` letters is replaced by digests of its two parts, so
rows stay small and a word of a million letters costs time in proportion.

Words are runs of ASCII letters (A-Z in lower case) and U+00C0 to U+00FF.
Null and empty texts have none, very long texts are read whole, repeated rows
count again, a null id is the empty text where ids matter, and an empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import col, materialize

LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_RATIO = 5
TERMINATOR = "$"
TEXT_LETTERS = 64
ROWS_AT_ONCE = 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
                  least_count: int = LEAST_COUNT, thin_every: int = 0) -> DataFrame:
    """(word, n): the words of enough letters and occurrences.

    With ``thin_every`` a word of a document loses a letter if that number
    divides the CRC-32 ``h`` of ``<id>:<word>``: the one at ``h % length``.
    """
    text = F.translate(F.coalesce(col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("word"))
    if thin_every:
        h = F.crc32(F.concat("i", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        thinned = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = (rows.withColumn("h", h).withColumn("word", F.when(F.col("h") % thin_every == 0, thinned).otherwise(F.col("word")))
                .where(F.length("word") >= least_letters))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def part_digests(word: str) -> tuple[list[bytes], list[bytes]]:
    """Digests of the first i letters, and of the letters from the i-th on, for every i, in one pass each."""

    def running(letters: str) -> list[bytes]:
        h = hashlib.sha256()
        out = [h.digest()[:16]]
        for x in letters:
            h.update(x.encode())
            out.append(h.copy().digest()[:16])
        return out

    return running(word), running(word[::-1])[::-1]


def rotation_keys(word: str) -> tuple[list[bytes], list[bytes]]:
    """Prefixes of the rotations without their last letter, by that letter's place; and of the whole rotations."""
    n = len(word)
    if n > TEXT_LETTERS:
        front, back = part_digests(word)

        def key(i: int, j: int) -> bytes:
            return b"\0" + back[j] + front[i]

        whole = [key(i, i) for i in range(n + 1)]
        if n - 1 > TEXT_LETTERS:
            return [key(i, i + 1) for i in range(n)], whole
    else:
        turned = (word + TERMINATOR) * 2
        whole = [turned[i:i + n + 1].encode() for i in range(n + 1)]
    return [f"{word[i + 1:]}{TERMINATOR}{word[:i]}".encode() for i in range(n)], whole


def rotations(words: DataFrame) -> DataFrame:
    """(key, id, n, letter): letter 0 for a whole rotation, 1 for one without its last letter, 2 if the
    letter before it in the word is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            sizes: list[tuple[int, int, int]] = []
            letters: list[int] = []

            def rows() -> pa.RecordBatch:
                ids, counts, times = (np.array(x, np.int64) for x in zip(*sizes, strict=True))
                out = pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(np.repeat(ids, times)), pa.array(np.repeat(counts, times)),
                     pa.array(letters, pa.int8())], names=["key", "id", "n", "letter"])
                keys.clear(), sizes.clear(), letters.clear()
                return out

            for i, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut, whole = rotation_keys(word)
                keys += cut
                letters += [1, *[2 if a == b else 1 for a, b in zip(word[1:], word[:-1], strict=True)]]
                keys += whole
                letters += [0] * len(whole)
                sizes.append((i, n, len(cut) + len(whole)))
                if len(keys) >= ROWS_AT_ONCE:
                    yield rows()
            if sizes:
                yield rows()

    return words.select("id", "word", "n").mapInArrow(run, "key binary, id long, n long, letter byte")


def group_neighbours(begin: np.ndarray, ids: np.ndarray, n: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, neighbours, best neighbour's n, its id) of the rows that have neighbours in their group.

    ``begin`` are the groups' first rows. Best is the largest n, then the smallest id.
    """
    none = len(ids)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, none)))
    order = np.lexsort((ids, -n))
    rank = np.empty(none, np.int64)
    rank[order] = np.arange(none)
    whole, cut, first = letter == 0, letter != 0, letter == 1

    def best(of: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(of, rank, none), begin)[group]

    best_cut, best_first, best_whole = best(cut), best(first), best(whole)
    second = best(cut & (rank != best_cut))
    n_cut, n_first = (np.add.reduceat(x.astype(np.int64), begin)[group] for x in (cut, first))
    meets_whole = first & (best_whole < none)
    count = np.where(whole, n_first, n_cut - 1 + meets_whole)
    other = np.where(rank == best_cut, second, best_cut)
    found = np.where(whole, best_first, np.where(meets_whole, np.minimum(other, best_whole), other))
    some = count > 0
    at = order[found[some]]
    return ids[some], count[some], n[at], ids[at]


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): for the words (id, word, n) that have neighbours, how many, and the best as (-n, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None  # the rows of the last group, which may go on

        def scanned(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            columns = group_neighbours(starts, *(np.asarray(rows.column(c)) for c in ("id", "n", "letter")))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "near", "best_n", "best_id"])

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if left is None else pa.concat_batches([left, batch])
            key = rows.column("key")
            new = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1))
            starts = np.append(0, 1 + np.flatnonzero(new.to_numpy(zero_copy_only=False)))
            if len(starts) > 1:
                yield scanned(rows.slice(0, starts[-1]), starts[:-1])
            left = rows.slice(starts[-1])
        if left is not None:
            yield scanned(left, np.zeros(1, np.int64))

    rows = rotations(words).repartition("key").sortWithinPartitions("key")
    found = rows.mapInArrow(run, "id long, near long, best_n long, best_id long")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"),
                                   F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_id").alias("id"))).alias("best"))


def chain_ends(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for the links (id, form): where following them ends. Links have no loops."""
    ends = materialize(links.select("id", F.col("form").alias("root")), "ends")
    for _ in range(max_rounds):
        ahead = ends.select(F.col("id").alias("root"), F.col("root").alias("ahead"))
        joined = materialize(ends.join(ahead, "root", "left"), "ends")
        if joined.where(F.col("ahead").isNotNull()).isEmpty():
            return ends
        ends = joined.select("id", F.coalesce("ahead", "root").alias("root"))
    raise RuntimeError("the links do not end")


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the distinct words (word, n).

    Near words differ by one inserted, deleted or replaced letter. A word's form
    is its near word of largest n (of equal ones the smallest), if that is at
    least ``ratio`` times the word's; its root is where the forms lead.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    numbered = materialize(words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
                           .withColumn("id", F.monotonically_increasing_id()), "words")
    near = materialize(neighbours(numbered), "near")
    with_n = numbered.select("id", "n").join(near, "id")
    links = with_n.where(-F.col("best.n") >= ratio * F.col("n")).select(
        "id", F.col("best.id").alias("form"), (-F.col("best.n")).alias("form_n"))
    links = materialize(links, "links")
    ends = chain_ends(links)

    def names(key: str, out: str) -> DataFrame:
        return numbered.select(F.col("id").alias(key), F.col("word").alias(out))

    named = (links.join(ends, "id").join(names("form", "form_word"), "form").join(names("root", "root_word"), "root")
             .select("id", "form_word", "form_n", "root_word"))
    return numbered.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
