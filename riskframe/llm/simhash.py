"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its
shingles. Two fingerprints at most ``k`` bits apart are linked. The 64 bits
are cut into ``k // 2 + 1`` segments, so one segment differs by at most one
bit. Each distinct fingerprint is indexed by every segment as it is and by
every segment with one bit left out (a one-wildcard variant); equality joins
on these keys give the candidates, and the whole fingerprints are compared.

Three things keep the joins small. A variant only meets the variants whose
left-out bit is the other one, so equal segments never meet through it. The
bits outside the segment then differ by at most ``k`` (or ``k - 1``), so they
are cut once more and one of their pieces is part of the key: a key holds a
few fingerprints even where many share a segment. And when no segment is
equal, at least ``2 * segments - k`` of them differ by exactly one bit, so
only the first ``k - segments + 1`` need variants.

Copies share a fingerprint and are joined once. Groups are the connected
components, found by star contraction on the links; each round is written
to the shared folder, and nothing but a count comes to the driver.

Null and empty texts have no words and the fingerprint zero, linked like any
other. A text of fewer words than a shingle is one shingle. Repeated rows
and rows without an id count as rows of their own; a group's id is its
smallest non-null document id (null if it has none). Very long texts are
hashed whole, and an empty table gives an empty result. Extra columns pass
through ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import col, free_name, materialize, utf8

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
COUNTED_AT_ONCE = 1 << 14


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text; a bit is set if more than half of the shingles' hashes have it."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    digest, n = xxhash.xxh64_digest, len(words) - shingle_words + 1
    hashes = b"".join([digest(line[a:b], SEED) for a, b in
                       zip(start[:n].tolist(), end[shingle_words - 1:].tolist(), strict=True)])
    votes = np.zeros(BITS, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, COUNTED_AT_ONCE):
        votes += np.unpackbits(rows[at:at + COUNTED_AT_ONCE], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint",
                     shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the fingerprint as a signed long. No shuffle."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = [fingerprint(v.as_py() or b"", shingle_words) for v in batch]
            yield pa.array(np.array(got, np.uint64).view(np.int64))

    return docs.withColumn(out_col, F.arrow_udf(run, "long")(utf8(text_col)))


def _cut(bits: list[int], pieces: int) -> list[list[int]]:
    """The bits in as many runs of nearly equal size."""
    edges = [len(bits) * i // pieces for i in range(pieces + 1)]
    return [bits[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def signature_plan(max_bits: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The keys of every fingerprint: (key number, mask) of exact segments, and
    (key number, mask, wildcard bit) of one-wildcard variants."""
    segments = _cut(list(range(BITS)), max_bits // 2 + 1)
    exact, wild = [], []
    for seg in segments:
        rest = [b for b in range(BITS) if b not in seg]
        for piece in _cut(rest, max_bits + 1) if rest else [[]]:
            exact.append((len(exact), _signed(seg + piece)))
    if max_bits:
        for seg in segments[:max_bits - len(segments) + 1]:
            rest = [b for b in range(BITS) if b not in seg]
            for piece in _cut(rest, max_bits) if rest else [[]]:
                for bit in seg:
                    wild.append((len(exact) + len(wild), _signed([b for b in seg if b != bit] + piece), bit))
    return exact, wild


def links(prints: DataFrame, fp: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): the pairs a < b of distinct fingerprints at most ``max_bits`` bits apart, some twice."""
    exact, wild = signature_plan(max_bits)
    f = F.col(fp)

    def keyed(rows: list[Column], out: str) -> DataFrame:
        return (prints.select(f.alias(out), F.explode(F.array(*rows)).alias("k"))
                .select(out, F.col("k.n").alias("n"), F.col("k.v").alias("v")))

    def key(n: int, mask: int) -> Column:
        return F.struct(F.lit(n).alias("n"), f.bitwiseAND(F.lit(mask).cast("long")).alias("v"))

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    same = [key(n, mask) for n, mask in exact]
    found = keyed(same, "a").join(keyed(same, "b"), ["n", "v"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    if wild:
        # Those with the wildcard bit clear meet those with it set.
        def side(out: str, bit_set: bool) -> DataFrame:
            rows = [F.when((F.shiftrightunsigned(f, b) % 2 != 0) == F.lit(bit_set), key(n, mask)) for n, mask, b in wild]
            return (prints.select(f.alias(out), F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("k"))
                    .select(out, F.col("k.n").alias("n"), F.col("k.v").alias("v")))

        met = side("a", False).join(side("b", True), ["n", "v"]).where(near)
        found = found.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node it reaches.

    Alternates large-star and small-star rounds until the edges stand still.
    Every round is written to the shared folder. Raises if they still move
    after ``max_rounds``, which is more than any graph of 2**50 nodes needs.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        moved = (joined.where(F.col("v") > F.col("u")) if large else joined).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame):
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where(F.col("a") != F.col("b")).distinct(), "edges")
    before = state(edges)
    for _ in range(max_rounds):
        edges = materialize(star(star(edges, True), False), "edges")
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")


def _classes(rows: DataFrame, fp: str, max_bits: int) -> DataFrame:
    """(fp, root) for every fingerprint that has a link to another; root is the group's smallest fingerprint."""
    prints = rows.select(fp).distinct()
    found = components(links(prints, fp, max_bits))
    return found.select(F.col("node").alias(fp), "root").unionByName(
        found.select(F.col("root").alias(fp), "root").distinct())


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): one row per document."""
    rows = materialize(with_fingerprint(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text",
                                        "fp", shingle_words).select("doc_id", "fp"), "fingerprints")
    roots = _classes(rows, "fp", max_bits)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))  # a row for each task and fingerprint
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(group, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row of the
    smallest id stays (rows without an id come last; of equal ids the first read)."""
    fp, rid = free_name(docs, "_fp"), free_name(docs, "_rid")
    rows = materialize(with_fingerprint(docs, text_col, fp, shingle_words)
                       .withColumn(rid, F.monotonically_increasing_id()), "rows")
    roots = _classes(rows, fp, max_bits)
    rank = F.struct(col(id_col).isNull().alias("n"), col(id_col).alias("i"), F.col(rid).alias("r"))
    least = rows.groupBy(fp).agg(F.min(rank).alias("least"))
    kept = (least.join(roots, fp, "left").groupBy(F.coalesce("root", fp).alias("root"))
            .agg(F.min("least").alias("least")).select(F.col("least.r").alias(rid)))
    return rows.join(kept, rid, "left_semi").drop(fp, rid)
