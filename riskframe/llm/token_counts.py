"""Token counts: count-only Viterbi over the matches of an Aho-Corasick automaton.

The automaton lists every vocabulary match of a unit by its end, longest
first. For each end, dynamic programming carries only the best score and the
number of pieces on its path: no ids, no back pointers. The tie rule is the
tokenizer's: the first path found stays unless a later one scores strictly
more, and paths are found by the start of their last piece. An uncovered
character counts as its UTF-8 bytes.

Null texts have a null count, empty texts 0. Repeated rows keep their rows,
extra columns pass through, very long texts are counted whole, and an empty
table gives an empty result. Units repeat, so a task counts each once while
its bounded cache holds it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import blocks, col, free_name, utf8
from riskframe.llm.unigram_vocab import UnigramVocab, load_vocab, unit_text, units_of

CACHED_UNITS = 400_000


def build_automaton(vocab: UnigramVocab) -> ahocorasick.Automaton:
    """All pieces with their length in characters and score."""
    automaton = ahocorasick.Automaton()
    for raw, (_, score) in vocab.pieces.items():
        piece = raw.decode()
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    return automaton


def count_unit(unit: str, automaton: ahocorasick.Automaton) -> int:
    """The number of pieces on the best path of a unit whose characters are all pieces."""
    best, count = [-inf] * (len(unit) + 1), [0] * (len(unit) + 1)
    best[0] = 0.0
    for end, (length, score) in automaton.iter(unit):
        end += 1
        path = best[end - length] + score
        if path > best[end]:
            best[end] = path
            count[end] = count[end - length] + 1
    return count[-1]


def count_uncovered_unit(unit: str, automaton: ahocorasick.Automaton, covered: frozenset[str],
                         unknown_score: float) -> int:
    """The same for any unit: a character without a piece of its own may also
    stand alone, after every longer piece that ends with it."""
    best, count = [-inf] * (len(unit) + 1), [0] * (len(unit) + 1)
    best[0] = 0.0
    matches = defaultdict(list)
    for end, match in automaton.iter(unit):
        matches[end + 1].append(match)
    for end, ch in enumerate(unit, 1):
        if ch not in covered:
            matches[end].append((1, unknown_score))
        for length, score in matches[end]:
            path = best[end - length] + score
            if path > best[end]:
                best[end] = path
                alone = length == 1 and ch not in covered
                count[end] = count[end - length] + (len(ch.encode()) if alone else 1)
    return count[-1]


class TokenCounter:
    """Counts the pieces of texts with a bounded cache of unit counts."""

    def __init__(self, vocab: UnigramVocab):
        self.vocab, self.automaton = vocab, build_automaton(vocab)
        self.covered = frozenset(p for p in (raw.decode() for raw in vocab.pieces) if len(p) == 1)
        self.known: dict[bytes, int] = {}

    def unit(self, unit: str) -> int:
        if self.covered.issuperset(unit):
            return count_unit(unit, self.automaton)
        return count_uncovered_unit(unit, self.automaton, self.covered, self.vocab.unknown_score)

    def count(self, texts: list[bytes | None]) -> list[int | None]:
        out: list[int | None] = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            units = units_of(t, self.vocab.dummy_prefix)
            if len(self.known) > CACHED_UNITS:
                self.known = {}
            for u in set(units):
                if u not in self.known:
                    self.known[u] = self.unit(unit_text(u).decode())
            out.append(sum(map(self.known.__getitem__, units)))
        return out


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out_col``, the number of pieces of each whole text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load_vocab(model_path)))  # as large as the vocabulary

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TokenCounter(UnigramVocab(*shared.value))
        for batch in batches:
            out: list[int | None] = []
            for block in blocks(v.as_py() for v in batch):
                out += counter.count(block)
            yield pa.array(out, pa.int64())

    return docs.withColumn(out_col, F.arrow_udf(run, "long")(utf8(text_col)))


def document_token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_bytes, bytes_per_token): one row per document; the
    ratio is null where there is no token."""
    out = free_name(docs, "_tokens")
    d = count_tokens(docs, model_path, text_col, out)
    n_bytes = F.octet_length(col(text_col).cast("string")).cast("long")
    return d.select(col(id_col).alias("doc_id"), d[out].alias("n_tokens"), n_bytes.alias("n_bytes"),
                    F.try_divide(n_bytes.cast("double"), d[out].cast("double")).alias("bytes_per_token"))
