"""Benchmark decontamination with training suffix arrays.

The training documents are cut into shards inside their own tasks. Each
shard's suffixes, as words, are sorted into a suffix array; every suffix of
every test item is then searched in it by bisection, all of them side by
side. The range of suffixes that begin with a test window gives its verbatim
locations; reading on from a location gives the longest verbatim match.

A test suffix holds only words of the test set, so a training word outside
that vocabulary ends every match: words become vocabulary numbers (0 for all
others) and only suffixes with enough known words in a row enter the array.
Suffixes are ordered as far as the longest test item reaches. Equal test
windows are searched once and keep the list of their items, so a passage that
thousands of items share costs one search, and its items are spread out once a
document. The longest match of a place is found by bisecting it in turn among
the sorted test suffixes.

The test set is taken in blocks of bounded size; each block's arrays are
broadcast on their own, and a shard is searched for one block after another.
Training text is never shuffled.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII
characters. A window is ``window_words`` consecutive words; an item of fewer
words, but not none, is one window. Null and empty texts have no words, and
items without words never occur. Repeated rows and rows without an id are
judged each for itself; repeated item ids count once a document, and an item
without an id hits words but is not counted. An empty test set leaves every document clean. A document longer than a shard is cut
into pieces that overlap by the longest item. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.byte_runs import runs
from riskframe.llm.common import blocks, col, free_name, utf8

WINDOW_WORDS = 10
SHARD_WORDS = 1 << 19
SHARD_BYTES = 1 << 22
TEST_BLOCK_BYTES = 16 << 20

# Word bytes to themselves, A-Z to a-z, every other byte to a blank.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
                   for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class TestBlock:
    """Test items as word numbers, one after another, each closed by 0."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        number = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in words] for _, words in items]
        self.longest = max(map(len, number), default=0)
        self.words = np.array([x for n in number for x in (*n, 0)] + [0] * (self.longest + 1), np.int32)
        # One entry per suffix that is long enough to be a window.
        size = np.array([min(window, len(n)) for n in number], np.int64)
        begin = np.cumsum([0] + [len(n) + 1 for n in number])[:-1] if number else np.zeros(0, np.int64)
        starts = [np.arange(len(n) - s + 1) for n, s in zip(number, size.tolist(), strict=True)]
        self.item = np.repeat(np.arange(len(number)), [len(s) for s in starts])
        self.offset = np.concatenate([np.zeros(0, np.int64), *starts])
        self.start = begin[self.item] + self.offset if number else np.zeros(0, np.int64)
        self.size = size[self.item] if number else np.zeros(0, np.int64)
        self.shortest = int(size.min()) if number else 0
        # Equal windows share a number; the suffixes of each stand together.
        numbers: dict[bytes, int] = {}
        data, width = self.words.tobytes(), self.words.itemsize
        self.window = np.array([numbers.setdefault(data[a * width:(a + n) * width], len(numbers))
                                for a, n in zip(self.start.tolist(), self.size.tolist(), strict=True)], np.int64)
        self.by_window = np.argsort(self.window, kind="stable")
        self.window_first = np.searchsorted(self.window[self.by_window], np.arange(len(numbers) + 1))
        example = self.by_window[self.window_first[:-1]]
        self.window_start, self.window_size = self.start[example], self.size[example]
        # The suffixes that can go on beyond a window in order, and their rank by item id and offset.
        self.full = window
        self.sorted = suffix_array(self.words, self.start[self.size == window], self.longest + 1)
        self.sorted_item = np.searchsorted(begin, self.sorted, side="right") - 1
        self.sorted_offset = self.sorted - begin[self.sorted_item] if number else self.sorted
        names = [(i is None, str(i)) for i in self.ids]
        by_name = np.empty(len(names), np.int64)
        by_name[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        self.name_rank = by_name
        rank = np.empty(len(self.sorted), np.int64)
        rank[np.lexsort((self.sorted_offset, by_name[self.sorted_item]))] = np.arange(len(self.sorted))
        self.sorted_rank = rank

    def suffixes_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given windows, suffix) for every suffix that begins with one."""
        n = self.window_first[windows + 1] - self.window_first[windows]
        which = np.repeat(np.arange(len(windows)), n)
        return which, self.by_window[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.window_first[windows], n)]

    def longest_from(self, at: np.ndarray) -> np.ndarray:
        """How many words of its item follow from each place."""
        stops = np.flatnonzero(self.words == 0)
        return stops[np.searchsorted(stops, at)] - at


def suffix_array(words: np.ndarray, suffixes: np.ndarray, reach: int) -> np.ndarray:
    """The given suffixes in order of their first ``reach`` words, by prefix doubling.

    A 0 ends a suffix. ``words`` has at least ``reach`` zeros at its end.
    """
    rank = words.astype(np.int64)
    depth = 1
    while depth < reach:
        ahead = np.zeros_like(rank)
        ahead[:-depth] = rank[depth:]
        ahead[rank == 0] = 0
        key = rank * (int(rank.max()) + 1) + ahead
        live = np.flatnonzero(rank)
        _, order = np.unique(key[live], return_inverse=True)
        if depth > 1 and int(order.max(initial=-1)) + 1 == int(rank.max()):
            break  # no suffix was told apart any further
        rank = np.zeros_like(rank)
        rank[live] = order + 1
        depth *= 2
    return suffixes[np.argsort(rank[suffixes], kind="stable")]


def bisect_suffixes(words: np.ndarray, array: np.ndarray, test: np.ndarray, start: np.ndarray, size: np.ndarray,
                    after: bool) -> np.ndarray:
    """For each test window the first place in the array whose suffix is not less
    than the window (with ``after``: is greater and does not begin with it)."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        suffix, window, left = array[middle], start[open_], size[open_]
        less = np.full(len(open_), after)  # equal over the whole window: less only with ``after``
        live, k = np.arange(len(open_)), 0
        while len(live):
            a, b = words[suffix[live] + k], test[window[live] + k]
            differ = a != b
            less[live[differ]] = a[differ] < b[differ]
            k += 1
            live = live[~differ & (left[live] > k)]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)


def common_words(words: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from each training place and test place on, at most ``most``."""
    length, live, k = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(live):
        live = live[(most[live] > k) & (words[at[live] + k] == test[start[live] + k])]
        k += 1
        length[live] = k
    return length


def longest_at(words: np.ndarray, at: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each training place with a whole window the words of its longest match, and the
    range of the sorted test suffixes that have it."""
    stops = np.flatnonzero(words == 0)
    rest = np.minimum(stops[np.searchsorted(stops, at)] - at, block.longest)
    near = bisect_suffixes(block.words, block.sorted, words, at, rest, after=False)
    length = np.zeros(len(at), np.int64)
    for side in (near - 1, near):
        there = block.sorted[np.clip(side, 0, len(block.sorted) - 1)]
        length = np.maximum(length, common_words(words, at, block.words, there, rest))
    return (length, bisect_suffixes(block.words, block.sorted, words, at, length, after=False),
            bisect_suffixes(block.words, block.sorted, words, at, length, after=True))


def shard_matches(words: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shard, test window): every occurrence of a distinct test window.

    ``words`` are vocabulary numbers with ``block.longest`` zeros at the end.
    """
    none = np.zeros(0, np.int64)
    begin, end = runs((words != 0).astype(np.int8))
    wide = end - begin >= max(block.shortest, 1)
    begin, size = begin[wide], (end - begin)[wide]
    if not len(begin) or not len(block.start):
        return none, none
    # The known words that are left, each run closed by one 0, and where each came from.
    shift = np.repeat(begin - (np.cumsum(size + 1) - size - 1), size + 1)
    origin = np.arange(len(shift)) + shift
    words = np.concatenate([words[origin], np.zeros(block.longest + 1, words.dtype)])
    words[np.cumsum(size + 1) - 1] = 0
    rest = np.repeat(np.cumsum(size + 1) - 1, size + 1) - np.arange(len(origin))
    known = np.flatnonzero(rest >= max(block.shortest, 1))
    array = suffix_array(words, known, block.longest)
    first = bisect_suffixes(words, array, block.words, block.window_start, block.window_size, after=False)
    last = bisect_suffixes(words, array, block.words, block.window_start, block.window_size, after=True)
    n = last - first
    window = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return origin[array[place]], window


def shards(texts: list[bytes | None], overlap: int) -> Iterator[list[tuple[int, int, list[bytes], int]]]:
    """Lists of (text number, first word, words, own words); a long text comes in
    pieces whose words go on for ``overlap`` beyond their own."""
    shard, size = [], 0
    for number, text in enumerate(texts):
        words = words_of(text or b"")
        for at in range(0, max(len(words), 1), SHARD_WORDS):
            piece = words[at:at + SHARD_WORDS + overlap]
            shard.append((number, at, piece, min(SHARD_WORDS, len(words) - at)))
            size += len(piece)
            if size >= SHARD_WORDS:
                yield shard
                shard, size = [], 0
    if shard:
        yield shard


def load_test_blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> list[Broadcast]:
    """The test set as broadcast blocks of at most TEST_BLOCK_BYTES of text each; one block passes the driver at a time."""
    spark = items.sparkSession
    out: list[Broadcast] = []
    block: list[tuple[object, list[bytes]]] = []
    size = 0

    def close() -> None:
        out.append(spark.sparkContext.broadcast(vars(TestBlock(block, window))))

    for row in items.select(col(id_col).alias("i"), utf8(text_col).alias("t")).toLocalIterator():
        words = words_of(bytes(row["t"] or b""))
        if words:
            block.append((row["i"], words))
            size += len(row["t"])
        if size >= TEST_BLOCK_BYTES:
            close()
            block, size = [], 0
    if block:
        close()
    return out


def _opened(shared: Broadcast) -> TestBlock:
    block = TestBlock.__new__(TestBlock)
    vars(block).update(shared.value)
    return block


class Verdict(NamedTuple):
    words: int
    hit: int                # words inside an occurrence of a window
    items: set              # ids of the items that occur
    longest: int            # words of the longest verbatim match
    place: int | None       # where it begins in the text (the first such word)
    item: object | None     # the smallest item, by id as text, that has it, and its first word there
    item_word: int | None


def judge_texts(texts: list[bytes | None], test_blocks) -> list[Verdict]:
    number_words = [0] * len(texts)
    hit: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    # Of each text the best match as (-words, place, id is null, id as text, word in the item, id).
    best: list[tuple] = [(0, -1, False, "", -1, None) for _ in texts]
    opened = list(test_blocks)
    overlap = max((b.longest for b in opened), default=1)
    for shard in shards(texts, overlap):
        own_words = np.array([s[3] for s in shard])
        for number, at, _, own in shard:
            number_words[number] = max(number_words[number], at + own)
        for block in opened:
            get = block.vocab.get
            parts = [np.fromiter([get(w, 0) for w in words] + [0], np.int32, len(words) + 1) for _, _, words, _ in shard]
            begin = np.cumsum([0] + [len(p) for p in parts])
            words = np.concatenate([*parts, np.zeros(block.longest + 1, np.int32)])
            place, window = shard_matches(words, block)
            if not len(place):
                continue
            piece = np.searchsorted(begin, place, side="right") - 1
            word = place - begin[piece]
            mine = word < own_words[piece]  # the rest belongs to the next piece
            place, window, piece, word = place[mine], window[mine], piece[mine], word[mine]
            order = np.argsort(piece, kind="stable")
            cuts = np.searchsorted(piece[order], np.arange(len(shard) + 1))
            tried = np.unique(place[block.window_size[window] == block.full])
            length, first, last = longest_at(words, tried, block)
            tried_cuts = np.searchsorted(tried, begin)
            for k in np.unique(piece).tolist():
                number, at = shard[k][:2]
                rows = order[cuts[k]:cuts[k + 1]]
                _, suffix = block.suffixes_of(np.unique(window[rows]))
                items[number].update(block.ids[i] for i in np.unique(block.item[suffix]).tolist())
                spans = np.unique(np.stack([word[rows] + at, word[rows] + at + block.window_size[window[rows]]], axis=1), axis=0)
                hit[number].extend(map(tuple, spans.tolist()))
                here = slice(tried_cuts[k], tried_cuts[k + 1])
                held = np.flatnonzero(tried[here] - begin[k] < own_words[k]) + tried_cuts[k]
                if len(held):
                    top = held[length[held].argmax()]
                    test = first[top] + block.sorted_rank[first[top]:last[top]].argmin()
                    n, where, offset = int(length[top]), int(tried[top] - begin[k]), int(block.sorted_offset[test])
                    found = block.ids[block.sorted_item[test]]
                else:  # only items shorter than a window
                    sizes = block.window_size[window[rows]]
                    top = rows[np.lexsort((word[rows], -sizes))[0]]
                    _, suffix = block.suffixes_of(window[top:top + 1])
                    n, where, offset = int(sizes.max()), int(word[top]), 0
                    found = block.ids[block.item[suffix[block.name_rank[block.item[suffix]].argmin()]]]
                best[number] = min(best[number], (-n, where + at, found is None, str(found), offset, found))
    out = []
    for number in range(len(texts)):
        covered, upto = 0, 0
        for a, b in sorted(hit[number]):
            covered += max(0, b - max(a, upto))
            upto = max(upto, b)
        words, place, _, _, item_word, found = best[number]
        there = (-words, place, found, item_word) if words else (0, None, None, None)
        out.append(Verdict(number_words[number], covered, items[number] - {None}, *there))
    return out


VERDICT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, "
           "match_word long, match_item string, match_item_word long")


def with_verdict(docs: DataFrame, items: DataFrame, text_col: str = "text", out_col: str = "overlap",
                 item_id_col: str = "item_id", item_text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with a struct ``out_col`` of each text's overlap with the items. No shuffle of ``docs``."""
    test_blocks = load_test_blocks(items, item_id_col, item_text_col, window_words)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        opened = [_opened(b) for b in test_blocks]
        for batch in batches:
            rows = []
            for texts in blocks((v.as_py() for v in batch), SHARD_BYTES):
                for v in judge_texts(texts, opened):
                    names = ",".join(sorted(map(str, v.items)))
                    rows.append((v.words, v.hit, len(v.items), hashlib.sha256(names.encode()).hexdigest(), v.hit > 0, v.longest,
                                 v.place, None if v.item is None else str(v.item), v.item_word))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in VERDICT.split(", ")])

    return docs.withColumn(out_col, F.arrow_udf(run, VERDICT)(utf8(text_col)))


MATCHES = "item_id string, item_word long, length long, doc_id string, doc_word long"


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text",
                    window_words: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, item_word, length, doc_id, doc_word): for every test suffix that
    occurs with at least a window, its longest verbatim match and the smallest
    place (document, word) that has it. Each shard sends one row a test suffix."""
    test_blocks = load_test_blocks(items, item_id_col, item_text_col, window_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_opened(b) for b in test_blocks]
        overlap = max((b.longest for b in opened), default=1)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for shard in shards([v.as_py() for v in batch.column(1)], overlap):
                for block in opened:
                    get = block.vocab.get
                    parts = [np.fromiter([get(w, 0) for w in s[2]] + [0], np.int32, len(s[2]) + 1) for s in shard]
                    begin = np.cumsum([0] + [len(p) for p in parts])
                    words = np.concatenate([*parts, np.zeros(block.longest + 1, np.int32)])
                    place, window = shard_matches(words, block)
                    which, suffix = block.suffixes_of(window)
                    place = place[which]
                    start = block.start[suffix]
                    length = common_words(words, place, block.words, start, block.longest_from(start))
                    piece = np.searchsorted(begin, place, side="right") - 1
                    best: dict[int, tuple] = {}
                    for s, n, k, w in zip(suffix.tolist(), length.tolist(), piece.tolist(),
                                          (place - begin[piece]).tolist(), strict=True):
                        got = (-n, ids[shard[k][0]] or "", shard[k][1] + w)
                        best[s] = min(best.get(s, got), got)
                    rows += [(str(block.ids[block.item[s]]), int(block.offset[s]), -b[0], b[1], b[2])
                             for s, b in best.items()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["item_id", "item_word", "length", "doc_id", "doc_word"])

    found = docs.select(col(id_col).cast("string").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, MATCHES)
    place = F.struct((-F.col("length")).alias("n"), "doc_id", "doc_word")
    return found.groupBy("item_id", "item_word").agg(F.min(place).alias("best")).select(
        "item_id", "item_word", (-F.col("best.n")).alias("length"), "best.doc_id", "best.doc_word")


def overlap_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, items_sha256, contaminated, and its
    longest verbatim match: longest_match (words), match_word (where it begins), match_item and
    match_item_word (the item that has it; nulls where nothing matches)."""
    out = free_name(docs, "_overlap")
    return with_verdict(docs, items, out_col=out, **kw).select(col(id_col).alias("doc_id"), f"{out}.*")


def remove_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` in which no test window occurs, with its own columns."""
    out = free_name(docs, "_overlap")
    return with_verdict(docs, items, out_col=out, **kw).where(~F.col(f"{out}.contaminated")).drop(out)
