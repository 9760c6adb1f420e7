"""Structured Streaming forms of alerting (T-1), the ledger (T-3) and scoring (T-2).

The keyed jobs hand every micro-batch to the batch operator together with
the state that earlier batches left (a count, or the last signature and
sequence, one row per key). Output and state of a batch are folders named by
the batch number in the shared checkpoint folder and are overwritten when a
batch is run again, so a restarted query goes on exactly where it stopped.
No key's rows are gathered in one task, except that a ledger chain is signed
in order, streaming, which its definition asks for. The jobs need no event
time and set no watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import join_keys
from riskframe.operators import alerts, ledger, score
from riskframe.operators.ranks import occurrence_number, previous_value
from riskframe.session import checkpoint_path, written


def run_stateful(spark: SparkSession, stream: DataFrame, name: str, state_schema: str,
                 step: Callable[[DataFrame, DataFrame], DataFrame],
                 next_state: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Drain the available input batch by batch and return the written output.

    ``step(batch, state)`` gives a batch's output; ``next_state(state,
    output)`` the state after it.
    """
    base = checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex}")

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = (session.read.schema(state_schema).parquet(f"{base}/state/{number - 1}") if number
                 else session.createDataFrame([], state_schema))
        step(batch, state).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        out = session.read.parquet(f"{base}/out/batch={number}")
        next_state(state, out).write.mode("overwrite").parquet(f"{base}/state/{number}")

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def alert_stream(spark: SparkSession, events: DataFrame, severity: str, event_type: str, order: str) -> DataFrame:
    """Threshold alerts over a stream: a row per event with its occurrence number
    per (severity, event type), which goes on across batches, the threshold,
    ``alert_triggered`` and the playbook action. Inside a batch events count
    in ``order``; batches count as they come."""
    keys = ["severity", "event_type"]
    base = events.select(F.col(order), F.col(severity).alias("severity"), F.col(event_type).alias("event_type"))

    def step(batch: DataFrame, state: DataFrame) -> DataFrame:
        counted = join_keys(occurrence_number(batch, keys, order), state, keys, "left")
        d = counted.withColumn("occurrence", F.col("occurrence") + F.coalesce("count", F.lit(0))).drop("count")
        d = d.withColumn("threshold", alerts.threshold_of("severity"))
        d = d.withColumn("alert_triggered", F.col("occurrence") >= F.col("threshold"))
        return d.withColumn("response", F.when(F.col("alert_triggered"), alerts.playbook_of("event_type")))

    def next_state(state: DataFrame, out: DataFrame) -> DataFrame:
        seen = out.select(*keys, F.col("occurrence").alias("count"))
        return state.unionByName(seen).groupBy(*keys).agg(F.max("count").alias("count"))

    return run_stateful(spark, base, "alerts", "severity string, event_type string, count long", step, next_state)


def ledger_stream(spark: SparkSession, events: DataFrame, key: bytes, chain: str, seq: str, payload: str) -> DataFrame:
    """(chain, seq, payload, signature, late) over a stream: rows of a batch are
    signed in sequence order from the chain's last signature. A row whose
    sequence is null or not above the last signed one is late and stays
    unsigned, and of a batch's rows with the same chain and sequence all but
    the first by payload. Every row comes out once."""
    base = events.select(F.col(chain).alias("chain"), F.col(seq).cast("long").alias("seq"), F.col(payload).alias("payload"))

    def step(batch: DataFrame, state: DataFrame) -> DataFrame:
        repeat = F.row_number().over(Window.partitionBy("chain", "seq").orderBy("payload")) > 1
        old = F.col("seq").isNull() | F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False))
        rows = join_keys(batch, state, ["chain"], "left").withColumn("late", old | repeat)
        signed = ledger.ledger_sign(rows.where("NOT late"), key, "chain", "seq", "payload", start="last_sig")
        signed = signed.withColumn("late", F.lit(False))
        return join_keys(rows.select("chain", "seq", "payload", "late"), signed, ["chain", "seq", "late"], "left").select(
            "chain", "seq", "payload", "signature", "late")

    def next_state(state: DataFrame, out: DataFrame) -> DataFrame:
        new = out.where("NOT late").select("chain", F.col("signature").alias("last_sig"), F.col("seq").alias("last_seq"))
        return state.unionByName(new).groupBy("chain").agg(F.max_by("last_sig", "last_seq").alias("last_sig"),
                                                           F.max("last_seq").alias("last_seq"))

    return run_stateful(spark, base, "ledger", "chain long, last_sig string, last_seq long", step, next_state)


def verify_stream(spark: SparkSession, signed: DataFrame, key: bytes, chain: str, seq: str, payload: str,
                  signature: str = "signature") -> DataFrame:
    """(chain, seq, status) of every signed row of a stream, checked as it comes:
    VERIFIED or TAMPERED against the row's payload and the signature reported before it,
    which is carried over batches; UNSIGNED without a signature; LATE where the
    sequence is null, repeated or not above the chain's last one. Agrees with
    ``ledger_verify`` and, like it, checks a chain's rows in parallel."""
    base = signed.select(F.col(chain).alias("chain"), F.col(seq).cast("long").alias("seq"), F.col(payload).alias("payload"),
                         F.col(signature).alias("signature"))

    def step(batch: DataFrame, state: DataFrame) -> DataFrame:
        rows = written(join_keys(batch, state, ["chain"], "left"), "batch")
        old = F.col("seq").isNull() | F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False))
        has = rows.where("signature IS NOT NULL").withColumn("old", old)
        has = has.withColumn("late", F.col("old") | (F.row_number().over(Window.partitionBy("chain", "seq").orderBy("signature", "payload")) > 1))
        has = written(has, "signed")
        good = previous_value(has.where("NOT late"), ["chain"], "seq", "signature", "before")
        message = F.concat(F.coalesce("payload", F.lit(ledger.NULL_PAYLOAD)), F.coalesce("before", "last_sig", F.lit("")))
        checked = good.withColumn("status", F.when(ledger.hmac_sha256(key, message).eqNullSafe(F.col("signature")), "VERIFIED").otherwise("TAMPERED"))
        rest = has.where("late").withColumn("status", F.lit("LATE")).unionByName(
            rows.where("signature IS NULL").withColumn("status", F.lit("UNSIGNED")), allowMissingColumns=True)
        columns = ["chain", "seq", "signature", "status"]
        return checked.select(*columns).unionByName(rest.select(*columns))

    def next_state(state: DataFrame, out: DataFrame) -> DataFrame:
        new = out.where("status IN ('VERIFIED', 'TAMPERED')").select("chain", F.col("signature").alias("last_sig"), F.col("seq").alias("last_seq"))
        return state.unionByName(new).groupBy("chain").agg(F.max_by("last_sig", "last_seq").alias("last_sig"),
                                                           F.max("last_seq").alias("last_seq"))

    return run_stateful(spark, base, "verify", "chain long, last_sig string, last_seq long", step, next_state).drop("signature")


def scoring_stream(records: DataFrame) -> DataFrame:
    """Stateless streaming scoring: validate -> score -> band -> factors; rejected
    rows keep their violations (see ``accepted`` and ``rejected``)."""
    return score.batch_score(records)


def accepted(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("valid")).drop("violations")


def rejected(scored: DataFrame) -> DataFrame:
    """The reject sink's rows: the record and the rules it breaks."""
    return scored.where(~F.col("valid"))


def run_available_now(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Drain every available input file into a parquet sink under the shared
    checkpoint folder (one new folder per run) and return the written table."""
    base = checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/_checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def file_stream(spark: SparkSession, directory: str, schema, glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """Parquet file source over ``directory`` (files matching ``glob``); ``max_files`` per trigger, or all that wait."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(directory)
