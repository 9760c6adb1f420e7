"""Helpers shared by the operators: shared tables, free column names, batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import checkpoint_path

TEXT_BLOCK_BYTES = 1 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage and fixes row-level values such as generated ids; a lost
    executor costs only a re-read of that table.
    """
    path = checkpoint_path(df.sparkSession, f"llm-{uuid.uuid4().hex}/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(name: str) -> Column:
    """A text column as its UTF-8 bytes."""
    return col(name).cast("string").cast("binary")


def blocks(texts: Iterable[bytes | None], limit: int = TEXT_BLOCK_BYTES) -> Iterator[list[bytes | None]]:
    """Consecutive texts in blocks of about ``limit`` bytes; one longer text is a block of its own."""
    block: list[bytes | None] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t or b"")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block
