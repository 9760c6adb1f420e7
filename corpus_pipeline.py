"""The corpus pipeline: documents through quality rules, near-duplicate
removal, benchmark decontamination, secret redaction and tokenisation.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``; a row is kept or dropped whole,
and the secret stage rewrites ``text`` (and ``n_chars``). Very long texts are
read whole, extra columns pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontaminate, quality_rules, secret_scan, sentencepiece_codec, simhash
from riskframe.session import checkpoint_path
from riskframe.sources.tables import table

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: null and empty texts go, repeated rows are
    judged each for itself; without labels only the base rules decide."""
    return quality_rules.keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one of the smallest id (rows without an id
    come last, of equal ids the first read); null and empty texts are one group."""
    return simhash.keep_one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of a benchmark item; without items, or for a null or
    empty text, nothing goes."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets that are not widely copied examples; every row stays, a null text as it is."""
    return secret_scan.redact(docs, size_col="n_chars")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, round_trip) of every document that is left; a null text has
    null ids, repeated rows keep their rows."""
    return sentencepiece_codec.encoded_documents(docs, PIECE_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secret_scan", secret_stage),
    ("sentencepiece", token_stage),
]

# SQL has neither SimHash, suffix arrays nor Viterbi paths; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    folder = checkpoint_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{n}_{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
