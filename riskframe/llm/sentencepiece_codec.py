"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The trie of all pieces is two integer arrays (``base``, ``check``) and a
piece id per state. A task collects the units of a block of texts that it has
not met yet and walks the trie from every character of all of them at once;
the Viterbi steps then run over all units side by side, one start offset
after another. Ties keep the path whose last piece starts first, as in the
public library. Scores add up in float64, so a long text does not lose
digits; a character that no piece covers becomes its UTF-8 bytes.

Null texts have null ids, empty texts have none. Repeated rows and extra
columns pass through unchanged. A text of any length is one row; its units
are encoded block by block. An empty table gives an empty result. Decoding turns markers into blanks, drops the
one blank that the dummy prefix adds, and turns invalid UTF-8 into U+FFFD;
so every text without a literal U+2581 comes back unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import blocks, col, free_name, utf8
from riskframe.llm.unigram_vocab import UnigramVocab, load_vocab, unit_text, units_of

CACHED_UNITS = 200_000
RESULT = "ids array<int>, n_tokens long, ids_sha256 string, decoded string"


class DoubleArrayTrie:
    """States are slots of one array: the child of ``s`` by byte ``c`` is slot
    ``base[s] + c`` if its ``check`` is ``s``. Slot 0 is the root; ``piece``
    holds the piece id that ends in a slot, or -1."""

    def __init__(self, pieces: dict[bytes, tuple[int, float]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for raw, (piece_id, _) in pieces.items():
            node = 0
            for c in raw:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = piece_id
        # Place the wide nodes first and let the many one-child nodes fill the holes.
        used = bytearray(2 * len(children) + 1024)
        used[0] = 1
        base_of, slot_of = [0] * len(children), [0] * len(children)
        free, near = 256, 256  # the first free slot that any byte can reach, and where wider searches start
        for node in sorted(range(len(children)), key=lambda n: -len(children[n])):
            kids = children[node]
            if not kids:
                break
            while used[free]:
                free += 1
            low, near = min(kids), max(near, free)
            at, tries = (free if len(kids) == 1 else near) - low, 0
            while any(used[at + c] for c in kids):
                at, tries = at + 1, tries + 1
            if tries > 64:
                near = at + low - 32
            if at + 600 > len(used):
                used.extend(bytes(len(used)))
            base_of[node] = at
            for c, child in kids.items():
                used[at + c] = 1
                slot_of[child] = at + c
        size = max(base_of) + 257  # a state's base plus any byte stays inside the arrays
        self.base, self.check, self.piece = (np.full(size, v, np.int32) for v in (0, -1, -1))
        for node, slot in enumerate(slot_of):
            self.base[slot], self.piece[slot] = base_of[node], ends[node]
            for child in children[node].values():
                self.check[slot_of[child]] = slot


class UnigramEncoder:
    """Encodes units; ``scores`` is indexed by piece id."""

    def __init__(self, vocab: UnigramVocab, trie: DoubleArrayTrie):
        self.trie, self.vocab = trie, vocab
        self.scores = np.zeros(len(vocab.texts))
        for piece_id, score in vocab.pieces.values():
            self.scores[piece_id] = score
        self.byte_ids = np.array(vocab.byte_ids, np.int32)

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        """The piece ids of each unit, as little-endian int32 bytes.

        All units lie in one buffer, each closed by 0xFF, which no piece
        holds. Step ``j`` walks the trie from character ``j`` of every unit
        that has one; longer units come first, so these are a prefix.
        """
        raw = [unit_text(u) for u in units]
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        data = np.frombuffer(b"\xff".join([raw[i] for i in order]) + b"\xff", np.uint8)
        shut = np.flatnonzero(data == 0xFF).astype(np.int32)
        opened = np.concatenate([[0], shut[:-1] + 1]).astype(np.int32)
        chars = np.flatnonzero(((data & 0xC0) != 0x80)).astype(np.int32)  # the closing bytes count as characters
        first = np.searchsorted(chars, opened).astype(np.int32)
        size = np.searchsorted(chars, shut).astype(np.int32) - first
        by_size = np.argsort(-size, kind="stable")
        first, size = first[by_size], size[by_size]
        best = np.full(len(data), -np.inf)
        best[opened] = 0.0
        back, last = np.zeros(len(data), np.int32), np.full(len(data), -1, np.int32)
        live = len(size)
        for j in range(int(size[0]) if live else 0):
            while size[live - 1] <= j:
                live = int(np.searchsorted(-size, -j, side="left"))
            self._from_char(data, chars, first[:live] + j, best, back, last)
        ids = self._ids(opened, shut, back, last, data)
        out: list[bytes] = [b""] * len(raw)
        for i, got in zip(order, ids, strict=True):
            out[i] = got
        return out

    def _from_char(self, data, chars, at, best, back, last) -> None:
        """Extends the best paths to these characters by every piece that starts there."""
        trie, start, stop = self.trie, chars[at], chars[at + 1]
        score, alone = best[start], np.ones(len(at), bool)
        row, state, pos = np.arange(len(at), dtype=np.int32), np.zeros(len(at), np.int32), start
        while len(row):
            slot = trie.base[state] + data[pos]
            child = np.flatnonzero(trie.check[slot] == state)
            row, state, pos = row[child], slot[child], pos[child] + 1
            ids = trie.piece[state]
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                found, end, piece = row[hit], pos[hit], ids[hit]
                alone[found[end == stop[found]]] = False
                self._update(found, end, piece, score[found] + self.scores[piece], start, best, back, last)
        lone = np.flatnonzero(alone)
        if len(lone):
            self._update(lone, stop[lone], np.full(len(lone), -1, np.int32), score[lone] + self.vocab.unknown_score,
                         start, best, back, last)

    @staticmethod
    def _update(row, end, piece, path, start, best, back, last) -> None:
        better = np.flatnonzero(path > best[end])
        end = end[better]
        best[end], back[end], last[end] = path[better], start[row[better]], piece[better]

    def _ids(self, opened, shut, back, last, data) -> list[bytes]:
        """Follows the back pointers of all units at once, then orders the pieces by unit and place."""
        found, live, pos, step = [np.zeros((3, 0), np.int64)], np.arange(len(opened)), shut, 0
        while len(live):
            prev, ids = back[pos], last[pos]
            known = ids >= 0
            found.append(np.stack([live[known], np.full(int(known.sum()), -step), ids[known]]))
            if not known.all():
                lone, a, b = live[~known], prev[~known], pos[~known]
                for k in range(4):  # a character has up to four bytes
                    has = a + k < b
                    found.append(np.stack([lone[has], np.full(int(has.sum()), k - step), self.byte_ids[data[a[has] + k]]]))
            step += 4  # leaves room for the bytes of a character
            going = prev > opened[live]
            live, pos = live[going], prev[going]
        table = np.concatenate(found, axis=1)
        table = table[:, np.argsort(table[0] * (step + 4) + table[1], kind="stable")]
        ids = table[2].astype("<i4").tobytes()
        cut = (4 * np.searchsorted(table[0], np.arange(len(opened) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class CachedEncoder:
    """Encodes whole texts, remembering units while they fit a bounded cache."""

    def __init__(self, vocab: UnigramVocab, trie: DoubleArrayTrie):
        self.encoder, self.vocab = UnigramEncoder(vocab, trie), vocab
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes | None]) -> list[bytes | None]:
        units = [None if t is None else units_of(t, self.vocab.dummy_prefix) for t in texts]
        if len(self.known) > CACHED_UNITS:
            self.known = {}
        new = [u for u in set().union(*[u for u in units if u]) if u not in self.known]
        if new:
            self.known.update(zip(new, self.encoder.encode_units(new), strict=True))
        get = self.known.__getitem__
        return [None if u is None else b"".join(map(get, u)) for u in units]


def decode_ids(ids: np.ndarray, texts: tuple[bytes, ...], dummy_prefix: bool) -> bytes:
    """The text of piece ids: bytes joined, one leading blank dropped, invalid UTF-8 replaced.

    Raises IndexError for an id that the vocabulary does not have.
    """
    if len(ids) and (ids.min() < 0 or ids.max() >= len(texts)):
        raise IndexError("an id outside the vocabulary")
    raw = b"".join(map(texts.__getitem__, ids.tolist()))
    if dummy_prefix and raw[:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def _trie(path: str) -> DoubleArrayTrie:
    return DoubleArrayTrie(load_vocab(path).pieces)


def result_of(ids: list[bytes | None], vocab: UnigramVocab | None) -> pa.StructArray:
    """RESULT rows of encoded texts; they are decoded again if ``vocab`` is given."""
    counts = np.array([0 if i is None else len(i) // 4 for i in ids], np.int64)
    null = np.array([i is None for i in ids], bool)
    flat = pa.Array.from_buffers(pa.int32(), int(counts.sum()), [None, pa.py_buffer(b"".join(i or b"" for i in ids))])
    decoded = [None if i is None or vocab is None else decode_ids(np.frombuffer(i, "<i4"), vocab.texts, vocab.dummy_prefix)
               for i in ids]
    return pa.StructArray.from_arrays([
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat, mask=pa.array(null)),
        pa.array(counts, mask=null),
        pa.array([None if i is None else hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
        pa.array(decoded, pa.binary()).cast(pa.string()),
    ], names=["ids", "n_tokens", "ids_sha256", "decoded"])


def _codec_udf(spark, model_path: str, decode: bool):
    shared = spark.sparkContext.broadcast((tuple(load_vocab(model_path)), vars(_trie(model_path))))  # a vocabulary's size

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields, arrays = shared.value
        vocab, trie = UnigramVocab(*fields), DoubleArrayTrie.__new__(DoubleArrayTrie)
        vars(trie).update(arrays)
        encoder = CachedEncoder(vocab, trie)
        for batch in batches:
            for block in blocks(v.as_py() for v in batch):  # one block's results at a time
                yield result_of(encoder.encode(block), vocab if decode else None)

    return F.arrow_udf(run, RESULT)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "pieces",
           decode: bool = False) -> DataFrame:
    """``docs`` with a struct ``out_col``: ids, n_tokens, ids_sha256 (of the ids
    as little-endian int32) and, if asked for, the text decoded from the ids.

    A narrow step: no shuffle, one block of texts in a task's memory at a time.
    """
    return docs.withColumn(out_col, _codec_udf(docs.sparkSession, model_path, decode)(utf8(text_col)))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with ``out_col``, the text of the piece ids (null for null)."""
    vocab = load_vocab(model_path)
    shared = rows.sparkSession.sparkContext.broadcast((vocab.texts, vocab.dummy_prefix))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        texts, prefix = shared.value
        for batch in batches:
            yield pa.array([None if v is None else decode_ids(np.asarray(v, np.int64), texts, prefix)
                            for v in batch.to_pylist()], pa.binary()).cast(pa.string())

    return rows.withColumn(out_col, F.arrow_udf(run, "string")(col(ids_col)))


def encoded_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, round_trip): one row per document.

    ``round_trip`` tells whether the decoded ids are the text again.
    """
    out, decoded = free_name(docs, "_pieces"), "decoded"
    d = encode(docs, model_path, text_col, out, decode=True)
    return d.select(
        col(id_col).alias("doc_id"), d[out]["n_tokens"].alias("n_tokens"), d[out]["ids"].alias("ids"),
        d[out]["ids_sha256"].alias("ids_sha256"), (col(text_col) == d[out][decoded]).alias("round_trip"))
