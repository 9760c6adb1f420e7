"""Threshold alerting (T-1, W-4) and quarantine state (Q-5), batch form.

The streaming form (keyed running counts across micro-batches) lives in
``riskframe.streaming``; both use the same threshold and playbook tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ranks import occurrence_number

# fixed values: alert thresholds by severity (others: 99)
THRESHOLDS = {"CRITICAL": 1, "HIGH": 3, "MEDIUM": 10}
DEFAULT_THRESHOLD = 99

# fixed values: incident playbook by event type
PLAYBOOK = {
    "AUTH_FAILURE": "Lock agent, rotate tokens, alert security team",
    "ARTIFACT_TAMPERED": "Halt pipeline, quarantine artifact, forensic analysis",
    "RED_TEAM_SCAN": "Block input, log to SIEM, trigger Red Team review",
    "PII_DETECTED": "Redact data, audit access logs, notify DPO (APP Principle 11)",
}
DEFAULT_ACTION = "Log and monitor"

# fixed values: release criteria with the artifact that meets each (None: the model gate)
RELEASE_CRITERIA = [
    ("All datasets validated", "dataset_catalog.json"),
    ("EDA completed", "eda_report.html"),
    ("Best model selected", None),
    ("SHAP completed", "shap_report.html"),
    ("LIME completed", "lime_report.html"),
    ("Security review passed", "guardrail_report.json"),
]
# fixed values: recommendation by verdict
RELEASE_TEXTS = {
    "REJECTED": "REJECTED — Data leakage detected. Re-run Agent 3 then Agent 6.",
    "APPROVED": "APPROVED FOR DEPLOYMENT",
    "CONDITIONAL": "CONDITIONAL — Review flagged items before deployment",
}


def threshold_of(severity) -> "F.Column":
    s = F.col(severity) if isinstance(severity, str) else severity
    expr = F.lit(DEFAULT_THRESHOLD)
    for k, v in THRESHOLDS.items():
        expr = F.when(s == k, F.lit(v)).otherwise(expr)
    return expr


def playbook_of(event_type) -> "F.Column":
    e = F.col(event_type) if isinstance(event_type, str) else event_type
    m = F.create_map(*[x for k, v in PLAYBOOK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, e), F.lit(DEFAULT_ACTION))


def alert_threshold(events: DataFrame, severity: str, event_type: str, order: str) -> DataFrame:
    """Per event: its occurrence number within (severity, event type) in
    ``order`` (unique); alert once the count reaches the severity threshold
    (every event from then on) with the playbook action. A key of any size
    is counted in ranges of the order, not in one task.
    """
    d = occurrence_number(events, [severity, event_type], order).withColumn("threshold", threshold_of(severity))
    return (d.withColumn("alert_triggered", F.col("occurrence") >= F.col("threshold"))
            .withColumn("response", F.when(F.col("alert_triggered"), playbook_of(event_type))))


def alert_totals(events: DataFrame, severity: str, event_type: str) -> DataFrame:
    """Order-free totals per key: events and alerts (= max(0, n - threshold + 1))."""
    g = events.groupBy(severity, event_type).agg(F.count(F.lit(1)).alias("events"))
    return g.withColumn("alerts", F.greatest(F.col("events") - threshold_of(severity) + 1, F.lit(0)))


def quarantine_state(log: DataFrame, artifact: str, action: str, seq: str) -> DataFrame:
    """Latest state per artifact from a log of QUARANTINE / APPROVE and neutral actions.

    A re-quarantine resets approval; an artifact is safe when it was never
    quarantined or its latest QUARANTINE / APPROVE action is APPROVE. Other
    actions change nothing.
    """
    decides = F.col(action).isin("QUARANTINE", "APPROVE")
    last = log.groupBy(artifact).agg(
        F.max_by(action, F.when(decides, F.col(seq))).alias("last_action"),
        F.count_if(F.col(action) == "QUARANTINE").alias("quarantines"))
    return last.withColumn("approved", F.coalesce(F.col("last_action") == "APPROVE", F.lit(False))).withColumn(
        "safe_to_deploy", (F.col("quarantines") == 0) | F.col("approved"))


def release_verdict(gate: DataFrame, artifacts: DataFrame, criteria: list[tuple[str, str | None]],
                    recommendations: dict[str, str]) -> DataFrame:
    """Release verdict from the model gate (one row: passed, leakage) and the
    artifact inventory (artifact, exists).

    ``criteria`` are (name, artifact): met if that artifact exists, or, with
    no artifact, if the gate is passed. Leakage -> REJECTED; all artifacts
    present and the gate passed -> APPROVED; else CONDITIONAL.
    """
    a = artifacts.agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(F.col("exists")).alias("present"),
                      F.collect_set(F.when(F.col("exists") & F.col("artifact").isin([x for _, x in criteria if x]),
                                           F.col("artifact"))).alias("_found"))  # at most one per criterion
    s = gate.join(a, how="cross")  # two one-row tables
    met = [F.when(F.col("passed") if x is None else F.array_contains("_found", x), F.lit(name)) for name, x in criteria]
    status = (F.when(F.col("leakage"), "REJECTED")
              .when(F.col("passed") & (F.col("present") == F.col("artifacts")), "APPROVED").otherwise("CONDITIONAL"))
    texts = F.create_map(*[F.lit(v) for kv in recommendations.items() for v in kv])
    out = s.withColumn("verdict", status).withColumn("met", F.array_compact(F.array(*met)))
    return out.select("passed", "leakage", "present", "artifacts", "met", F.size("met").alias("criteria_met"),
                      F.lit(len(criteria)).alias("criteria_total"), "verdict",
                      texts[F.col("verdict")].alias("recommendation"))


def quality_gate(prepared: DataFrame, strategy: str, report: DataFrame) -> DataFrame:
    """One row: shape of the prepared table, imbalance strategy, whether the quality report has rows."""
    shape = prepared.agg(F.count(F.lit(1)).alias("output_rows"))
    exists = report.agg((F.count(F.lit(1)) > 0).alias("quality_report_exists"))
    return shape.join(exists, how="cross").select(  # two one-row tables
        "output_rows", F.lit(len(prepared.columns)).alias("output_columns"), F.lit(strategy).alias("imbalance_strategy"),
        "quality_report_exists")


def score_router(score, critical=None) -> "F.Column":
    """>= .90 approved, >= .70 conditional, else rejected; blocked when critical > 0."""
    s = F.col(score) if isinstance(score, str) else score
    r = F.when(s >= 0.90, "approved").when(s >= 0.70, "conditional").otherwise("rejected")
    if critical is not None:
        c = F.col(critical) if isinstance(critical, str) else critical
        r = F.when(c > 0, "blocked").otherwise(r)
    return r
