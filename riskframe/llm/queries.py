"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (centroids, chat_format, decontaminate, langid, license_scan, oracles, quality_classifier, quality_rules,
                           secret_scan, sentencepiece_codec, simhash, spelling, token_counts, warc)
from riskframe.sources.tables import table

CHAT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return register


@query()
def op5_sentencepiece(spark, sf_dir):
    """Piece ids of every whole document and whether they decode to the text again."""
    return sentencepiece_codec.encoded_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


@query()
def op6_quality_rules(spark, sf_dir):
    """Base counts, likelihood ratio and verdict of every whole document."""
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_token_counts(spark, sf_dir):
    """Number of pieces of every whole document."""
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


@query()
def op4_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate group of every whole document."""
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


@query(oracles.DECONTAMINATE)
def op1_decontaminate(spark, sf_dir):
    """Overlap of every whole document with the benchmark items."""
    return decontaminate.overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(oracles.SECRET_SCAN)
def op3_secret_scan(spark, sf_dir):
    """Secrets of every whole document, with corpus-wide ownership; a source stands for an owner."""
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


CONTROL_CONVERSATION = """
SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
AS t(conv_id, turn, role, text)"""


@query(oracles.CHAT_FORMAT)
def op2_chat_format(spark, sf_dir):
    """Every conversation, and one whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(CONTROL_CONVERSATION))
    return chat_format.format_conversations(rows, CHAT_TOKENIZER).drop(
        "text", "ids", "loss_mask", "n_tokens", "n_loss_tokens")


@query(oracles.WARC)
def op8_warc(spark, sf_dir):
    """Every page written as a WARC record and read back from the archives."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), spark)


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % n


@query()
def op9_langid(spark, sf_dir):
    """Language of every whole document, learned on four of five folds."""
    return langid.language_report(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0)


@query()
def op10_quality_classifier(spark, sf_dir):
    """Quality score of every whole document, learned on three of four folds of the labels."""
    return quality_classifier.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 4) == 2)


@query(oracles.SPELLING)
def op11_spelling(spark, sf_dir):
    """Near words, form and root of every frequent word of the whole documents."""
    return spelling.spelling_variants(spelling.counted_words(table(spark, sf_dir, "documents"), thin_every=199))


@query(oracles.LICENSES)
def op12_license_scan(spark, sf_dir):
    """Phrases and license labels of every whole document."""
    return license_scan.license_report(table(spark, sf_dir, "documents"))


@query(oracles.CENTROIDS)
def op13_centroids(spark, sf_dir):
    """Cluster, distance, inertia and centroid of every whole vector."""
    return centroids.clustered_vectors(table(spark, sf_dir, "embeddings"))


@query()
def pipeline(spark, sf_dir):
    """The stages of ``corpus_pipeline`` over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
