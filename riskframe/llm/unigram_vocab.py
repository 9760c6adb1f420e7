"""Pieces, scores and text units of a SentencePiece unigram vocabulary.

The vocabulary file is read on the driver and travels with the job, so
executors need no copy. A text is normalised as the model says (identity
rule: white-space marker for a blank, optional marker in front) and cut into
units that no piece can cross; every unit is then encoded on its own, which
gives the same best path as the whole text because path scores add up.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

MARKER = "▁"
MARKER_UTF8 = MARKER.encode()
# Added to the lowest score for a character that no piece covers (fixed value of the unigram model).
UNKNOWN_PENALTY = 10.0
# Taken off a user-defined piece's bonus score (fixed value of the unigram model).
USER_DEFINED_MARGIN = 0.1
# Piece types of the model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

UNITS = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


class UnigramVocab(NamedTuple):
    """``pieces`` maps the matchable pieces to (id, score); ``texts`` is what each id decodes to."""

    pieces: dict[bytes, tuple[int, float]]
    byte_ids: tuple[int, ...]
    texts: tuple[bytes, ...]
    unknown_score: float
    dummy_prefix: bool


@lru_cache(maxsize=4)
def load_vocab(path: str) -> UnigramVocab:
    """Read a ``.model`` file. Raises for a file without byte pieces, with a
    normalisation table, or with a piece that crosses from text into a
    white-space marker: those need rules that this operator does not have."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("only vocabularies with identity normalisation are supported")
    scores = [p.score for p in model.pieces if p.type == NORMAL]
    lowest, highest = min(scores), max(scores)
    pieces, texts, byte_ids = {}, [], [-1] * 256
    for i, p in enumerate(model.pieces):
        text = p.piece.replace(MARKER, " ").encode()
        if p.type in (NORMAL, USER_DEFINED):
            raw = p.piece.encode()
            bonus = len(raw) * highest - USER_DEFINED_MARGIN
            pieces[raw] = (i, p.score if p.type == NORMAL else bonus)
            if re.search(f"[^{MARKER}]{MARKER}", p.piece):
                raise ValueError(f"piece {p.piece!r} crosses into a white-space marker")
        elif p.type == BYTE:
            value = int(p.piece[3:5], 16)
            byte_ids[value], text = i, bytes([value])
        elif p.type == UNKNOWN:
            text = " ⁇ ".encode()
        else:
            text = b""
        texts.append(text)
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary has no byte pieces to fall back on")
    return UnigramVocab(pieces, tuple(byte_ids), tuple(texts), lowest - UNKNOWN_PENALTY, norm.add_dummy_prefix)


def units_of(text: bytes, dummy_prefix: bool) -> list[bytes]:
    """The units of a text, each without the one marker that starts it.

    A first unit that starts without a marker (no dummy prefix) is marked by
    a leading 0xFF, which UTF-8 never holds.
    """
    if not text:
        return []
    if dummy_prefix and text[:1] != b" " and b"  " not in text and MARKER_UTF8 not in text:
        return text.split(b" ")
    s = text.decode("utf-8", "replace").replace(" ", MARKER)
    if dummy_prefix:
        s = MARKER + s
    return [u[1:].encode() if u[0] == MARKER else b"\xff" + u.encode() for u in UNITS.findall(s)]


def unit_text(unit: bytes) -> bytes:
    """The whole unit with its leading marker."""
    return unit[1:] if unit[:1] == b"\xff" else MARKER_UTF8 + unit
