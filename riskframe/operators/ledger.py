"""HMAC-chained event ledger (L-1..L-4, W-3, J-3, J-5, J-6, K-3, D-22..D-24, B-23).

Signing is sequential inside a chain: sig_i = HMAC-SHA256(key, payload_i ||
sig_{i-1}) with "" before the first event. Chains are independent, so the
table is hash-partitioned by chain and sorted by sequence inside each
partition; ``mapInArrow`` then folds every chain in order while streaming
the sorted rows, holding only the last signature per chain — a long chain
is processed in one task (its order is inherently serial) but never loaded
whole.

Verification is parallel within a chain too: the table is cut into ranges of
(chain, sequence), each row is paired with the previous row's *reported*
signature (carried over range borders) and its HMAC recomputed as a column
expression (nested SHA-256 over the ipad/opad key blocks).

A null payload is signed as the character U+0000, so it verifies as it was
written and an erased one is found. A null chain is a chain of its own.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from riskframe.operators.ranks import previous_value


def _pads(key: bytes) -> tuple[bytes, bytes]:
    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha256(key: bytes, message) -> Column:
    """HMAC-SHA256(key, message) as a hex string column, computed JVM-side."""
    ipad, opad = _pads(key)
    m = F.col(message) if isinstance(message, str) else message
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), F.encode(m, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)


NULL_PAYLOAD = "\0"


def _sign_partitions(key: bytes, chain: str, seq: str, payload: str):
    def fn(batches):
        last_chain, last_sig = object(), ""
        for b in batches:
            sigs = []
            for c, p, start in zip(*(b.column(x).to_pylist() for x in (chain, payload, "_start")), strict=True):
                if c != last_chain:
                    last_chain, last_sig = c, start
                message = (NULL_PAYLOAD if p is None else p) + last_sig
                last_sig = _hmac.new(key, message.encode("utf-8"), hashlib.sha256).hexdigest()
                sigs.append(last_sig)
            yield pa.RecordBatch.from_arrays([b.column(chain), b.column(seq), pa.array(sigs, pa.string())],
                                             names=[chain, seq, "signature"])
    return fn


def ledger_sign(df: DataFrame, key: bytes, chain: str, seq: str, payload: str, start: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """(chain, seq, signature) for every row, chained in ``seq`` order per chain.

    ``start`` names a column with the signature that a chain goes on from
    ("" or no column: a new chain).
    """
    fields = {f.name: f for f in df.schema.fields}
    schema = StructType([StructField(chain, fields[chain].dataType), StructField(seq, fields[seq].dataType),
                         StructField("signature", StringType())])
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    first = F.coalesce(F.col(start), F.lit("")) if start else F.lit("")
    parts = (df.select(chain, seq, payload, first.alias("_start")).repartition(int(n), chain).sortWithinPartitions(chain, seq))
    return parts.mapInArrow(_sign_partitions(key, chain, seq, payload), schema)


def ledger_verify(signed: DataFrame, key: bytes, chain: str, seq: str, payload: str,
                  signature: str = "signature") -> DataFrame:
    """Per row: expected HMAC over (payload || previous reported signature) and ``valid``.

    Unsigned rows (NULL signature) are skipped; a changed payload flags only
    its own row, a changed signature flags its row and the next.
    """
    s = previous_value(signed.where(F.col(signature).isNotNull()), [chain], seq, signature, "_prev")
    message = F.concat(F.coalesce(payload, F.lit(NULL_PAYLOAD)), F.coalesce("_prev", F.lit("")))
    v = s.withColumn("expected", hmac_sha256(key, message))
    return v.withColumn("valid", F.col("expected").eqNullSafe(F.col(signature))).drop("_prev")


def verify_summary(verified: DataFrame, chain: str) -> DataFrame:
    """Per chain: checked rows, tampered rows, VERIFIED / TAMPERED."""
    return (verified.groupBy(chain).agg(F.count(F.lit(1)).alias("checked"),
                                        F.count_if(~F.col("valid")).alias("tampered"))
            .withColumn("status", F.when(F.col("tampered") == 0, "VERIFIED").otherwise("TAMPERED")))


def handoff_messages(completed: DataFrame, stages: DataFrame, stage: str = "stage", artifact: str = "artifact") -> DataFrame:
    """``completed`` stage events with (sender, receiver, message_type, checksum): what each stage
    hands to the next. ``stages`` is (stage, name), numbered from 1, a row a stage; the last
    one has no receiver and sends nothing. The checksum is that of the artifact's path.
    """
    names = stages.select(F.col("stage").alias("_n"), F.col("name").alias("sender"))
    after = stages.select((F.col("stage") - 1).alias("_n"), F.col("name").alias("receiver"))
    pairs = F.broadcast(names.join(after, "_n"))  # a row a stage
    return (completed.join(pairs, F.col(stage) == F.col("_n")).drop("_n")
            .withColumn("message_type", F.lit("handoff")).withColumn("checksum", event_checksum(F.coalesce(artifact, F.lit("")))))


def event_checksum(artifact) -> Column:
    """SHA-256 of the artifact *path string* (as the stage log records it)."""
    a = F.col(artifact) if isinstance(artifact, str) else artifact
    return F.sha2(a, 256)


def verify_checksums(manifest: DataFrame, actual: DataFrame, key: str = "artifact",
                     expected: str = "expected", got: str = "actual") -> DataFrame:
    """Full outer join of expected vs recomputed checksums; MATCH / TAMPERED / MISSING / UNEXPECTED."""
    j = manifest.join(actual, key, "full_outer")
    return j.withColumn("status", F.when(F.col(expected).isNull(), "UNEXPECTED")
                        .when(F.col(got).isNull(), "MISSING")
                        .when(F.col(expected) == F.col(got), "MATCH").otherwise("TAMPERED"))


def tenant_scope(df: DataFrame, tenant_col: str, tenant) -> DataFrame:
    """Rows visible to one tenant."""
    return df.where(F.col(tenant_col) == F.lit(tenant))


def audit_tail(df: DataFrame, seq: str, n: int = 150) -> DataFrame:
    """Last ``n`` entries by sequence, newest first (a top-n report)."""
    return df.orderBy(F.col(seq).desc()).limit(n)


def assessment_lookup(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """First log entry per key (e.g. tenant, request id) as a nested JSON document."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.col(seq)).alias("_r"))
    return first.select(*keys, F.to_json("_r").alias("document"))


def tenant_stats(df: DataFrame, tenant: str, event_type: str, prob: str, high: str) -> DataFrame:
    """Per tenant over prediction events: count, % high risk (1 dp), mean probability (4 dp); 0 when empty."""
    p = df.where(F.col(event_type).isin("PREDICTION", "FHIR_PREDICTION"))
    return p.groupBy(tenant).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col(high)) * 100.0, F.count(F.lit(1))), F.lit(0.0)), 1)
        .alias("high_risk_pct"),
        F.round(F.coalesce(F.avg(prob), F.lit(0.0)), 4).alias("mean_probability"))


def prediction_summary(df: DataFrame, event_type: str, high: str) -> DataFrame:
    """Events whose type contains PREDICTION: total, high, low."""
    p = df.where(F.col(event_type).contains("PREDICTION"))
    return p.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(high)).alias("high"),
                 F.count_if(~F.col(high)).alias("low"))


def batch_summary(scored: DataFrame, batch: str, prediction: str, error: str) -> DataFrame:
    """Per batch: size, high-risk count and rows with an error."""
    return scored.groupBy(batch).agg(
        F.count(F.lit(1)).alias("batch_size"), F.count_if(F.col(prediction) == 1).alias("high_risk_count"),
        F.count_if(F.col(error).isNotNull()).alias("errors"))


def event_display(df: DataFrame, ts: str, keep: list[str], rest: list[str], width: int = 100) -> DataFrame:
    """Display projection: timestamp text (first 19 chars, T -> space) and the
    remaining fields as one JSON string cut to ``width`` characters."""
    t = F.regexp_replace(F.substring(F.col(ts).cast("string"), 1, 19), "T", " ")
    details = F.substring(F.to_json(F.struct(*[F.col(c) for c in rest])), 1, width)
    return df.select(t.alias("time"), *keep, details.alias("details"))
