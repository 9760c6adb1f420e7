"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered with a template whose marks stand around
every role and text; the marks and other control strings inside a role or
text are escaped reversibly. The marks are tokens of their own, added to the
tokenizer's vocabulary behind its last id, so every border of a text is a
token border and no token holds characters of both. The whole rendering is
encoded once, with the byte offsets of every token. Turn spans and token
spans are both sorted, so the tokens under the loss (the assistant texts) are
found by binary search.

The output is read back: turns by parsing the rendering, the trained text by
decoding the masked ids alone. A mask with one token too many or too few gives
another trained text.

Turns of a conversation are brought together by a shuffle on its id and
sorted by turn inside the task; rows stream by and one conversation is held
at a time, very long texts whole. Ties in the turn number are ordered by role,
then text. A null text or role is empty, a null turn comes first, and all
rows with a null conversation id are one conversation. Repeated rows are
turns of their own, empty conversations do not exist, an empty table gives an
empty result, and extra columns are not rendered.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import col

# The template's marks and other control strings that no text may bring in.
TURN_START, TURN_BREAK, TURN_END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = (TURN_START, TURN_BREAK, TURN_END)
CONTROL = (*MARKS, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"

# Fixed value: how the byte-level vocabulary's texts are cut before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space of this length is cut off by hand, as the pattern's look-ahead keeps a state for each blank.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")

# A control string with any number of backslashes after its first character; escaping adds one, unescaping takes one.
_ESCAPABLE = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROL))
_BARE = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(TURN_START) + r"(.*?)" + re.escape(TURN_BREAK) + r"(.*?)" + re.escape(TURN_END), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Rendering(NamedTuple):
    text: str
    starts: list[int]  # of the trained spans, in order, as UTF-8 bytes
    ends: list[int]


def render(turns: list[tuple[str, str]]) -> Rendering:
    """The text of a conversation and the spans of its trained turns."""
    parts, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = TURN_START + escape(role) + TURN_BREAK, escape(text)
        begin = at + len(head.encode())
        end = begin + len(body.encode())
        if role == TRAINED_ROLE:
            starts.append(begin)
            ends.append(end)
        parts += [head, body, TURN_END]
        at = end + len(TURN_END)
    return Rendering("".join(parts), starts, ends)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


class MarkedTokenizer:
    """A byte-level vocabulary (a line of base64 bytes and rank each) with the template's marks as tokens."""

    def __init__(self, ranks: bytes):
        import tiktoken

        ranked = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        after = max(ranked.values()) + 1
        marks = {mark: after + n for n, mark in enumerate(MARKS)}
        self.encoding = tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranked, special_tokens=marks)
        self.blanks = tiktoken.Encoding("blanks", pat_str=r"\s+", mergeable_ranks=ranked, special_tokens={})
        self.turn_start = marks[TURN_START]
        self.size = np.zeros(after + len(MARKS), np.int64)
        for token, rank in [*ranked.items(), *marks.items()]:
            self.size[rank] = len(token)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, end byte) of every token."""
        ids, at = [], 0
        for m in LONG_SPACE.finditer(text):
            end = m.end()
            if end < len(text) and not text.startswith(MARKS, end):
                end -= 1  # the last blank goes with the word behind it
            ids.append(self.encoding.encode_to_numpy(text[at:m.start()], allowed_special="all"))
            ids.append(self.blanks.encode_to_numpy(text[m.start():end]))
            at = end
        ids = np.concatenate([*ids, self.encoding.encode_to_numpy(text[at:], allowed_special="all")]).astype(np.int32)
        ends = np.cumsum(self.size[ids])
        return ids, ends - self.size[ids], ends

    def masked_texts(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The text of each turn's masked tokens. What no mask of whole texts can hold, bytes that are
        no UTF-8 and control strings without their escape, becomes replacement characters."""
        at = np.flatnonzero(mask)
        turn = np.cumsum(ids == self.turn_start)[at]
        cuts = np.flatnonzero(np.diff(turn)) + 1
        texts = [self.encoding.decode_bytes(x.tolist()).decode("utf-8", "replace") for x in np.split(ids[at], cuts) if len(x)]
        return [unescape(_BARE.sub("\ufffd", x)) for x in texts]


def token_mask(token_start: np.ndarray, token_end: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """Which tokens lie in a trained span; both lists are sorted, and span borders are token borders."""
    first = np.searchsorted(token_start, np.array(starts, np.int64), side="left")
    last = np.searchsorted(token_end, np.array(ends, np.int64), side="right")
    step = np.zeros(len(token_start) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.maximum(first, last), -1)  # an empty text trains no token
    return np.cumsum(step[:-1]) > 0


RESULT = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_tokens long, n_loss_tokens long, text string, ids array<int>, loss_mask array<boolean>")


def format_conversations(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: the rendering, its token ids and loss mask, and
    what reading them back gives (turns, trained text)."""
    with open(tokenizer_path, "rb") as f:
        shared = turns.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = MarkedTokenizer(shared.value)
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def formatted(conv_id: int | None, rows: list[tuple[str, str]]) -> tuple:
            r = render(rows)
            ids, first, end = tokenizer.encode(r.text)
            mask = token_mask(first, end, r.starts, r.ends)
            turns = parse(r.text)
            back = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(tokenizer.masked_texts(ids, mask))
            return (conv_id, len(turns), hashlib.sha256(back.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(r.text), len(mask), int(mask.sum()), r.text,
                    ids, mask)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            *plain, ids, masks = zip(*rows, strict=True)
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (ids, masks)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(plain, kinds, strict=True)] + lists, names=names)

        current, held, done, size = None, [], [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv_id != current:
                    done.append(formatted(current, held))
                    size += done[-1][5]
                    held = []
                    if size > 1 << 20:
                        yield batch_of(done)
                        done, size = [], 0
                current = conv_id
                held.append((role, text))
        if held:
            done.append(formatted(current, held))
        if done:
            yield batch_of(done)

    empty = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    rows = turns.select(col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), empty(role_col).alias("role"),
                        empty(text_col).alias("text"))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(run, RESULT)
