"""Registered ledger, alerting, scoring, FHIR and release queries
(L-*, T-1, W-3, W-4, Q-*, D-22..D-24, J-5, J-6, K-3, B-12..B-18, B-21, B-23, M-19, F-*, S-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import alerts, fhir, ledger, score
from riskframe.plans import fixtures_sql as fx
from riskframe.plans import q_metrics
from riskframe.plans.registry import fixture, register, views

# test-only ledger key: a parameter of the operators, never a library constant
TEST_KEY = b"riskframe-test-key"

LEDGER_EVENTS = """
SELECT event_id, user_id, CAST(user_id % 2 AS STRING) AS tenant_id, concat(event_type, ':', props) AS payload
FROM events
"""

SCORING_LOG = """
SELECT event_id AS seq, CAST(user_id % 2 AS STRING) AS tenant_id, concat('req-', CAST(user_id AS STRING)) AS request_id,
       CASE WHEN event_type IN ('purchase', 'click') THEN 'PREDICTION'
            WHEN event_type = 'signup' THEN 'FHIR_PREDICTION' ELSE upper(event_type) END AS event_type,
       CAST((event_id * 37) % 100 AS DOUBLE) / 100.0 AS probability,
       ((event_id * 37) % 100) >= 75 AS high_risk, ts
FROM events
"""


def _hmac_sql(msg: str) -> str:
    ip, op = ledger._pads(TEST_KEY)
    return f"sha256(unhex('{op.hex()}') || unhex(sha256(unhex('{ip.hex()}') || encode({msg}))))"


_SIGN_CTE = f"""RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ({LEDGER_EVENTS}) x),
chain(user_id, k, event_id, signature) AS (
  SELECT user_id, k, event_id, {_hmac_sql("payload")} FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, e.event_id, {_hmac_sql("e.payload || c.signature")}
  FROM chain c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)"""

ORACLE_SIGN = f"WITH {_SIGN_CTE} SELECT user_id, event_id, signature FROM chain"


def _ledger(spark, sf_dir):
    return fixture(spark, sf_dir, LEDGER_EVENTS, "events")


@register("ledger_sign", ORACLE_SIGN)
def q_sign(spark, sf_dir):
    """HMAC chain per user over every event, in event-id order."""
    return ledger.ledger_sign(_ledger(spark, sf_dir), TEST_KEY, "user_id", "event_id", "payload")


ORACLE_VERIFY = f"""WITH {_SIGN_CTE},
t AS (SELECT e.user_id, e.event_id, CASE WHEN e.event_id % 101 = 0 THEN e.payload || ' (edited)' ELSE e.payload END AS payload,
             c.signature FROM e JOIN chain c ON c.event_id = e.event_id),
v AS (SELECT *, {_hmac_sql("payload || coalesce(lag(signature) OVER (PARTITION BY user_id ORDER BY event_id), '')")} AS expected FROM t)
SELECT user_id, count(*) AS checked, count(*) FILTER (WHERE expected <> signature) AS tampered,
       CASE WHEN count(*) FILTER (WHERE expected <> signature) = 0 THEN 'VERIFIED' ELSE 'TAMPERED' END AS status
FROM v GROUP BY user_id"""


@register("ledger_verify", ORACLE_VERIFY)
def q_verify(spark, sf_dir):
    """Sign every chain, edit the payload of some rows, verify all rows in parallel."""
    ev = _ledger(spark, sf_dir)
    signed = ledger.ledger_sign(ev, TEST_KEY, "user_id", "event_id", "payload")
    tampered = (ev.join(signed, ["user_id", "event_id"])
                .withColumn("payload", F.when(F.col("event_id") % 101 == 0, F.concat("payload", F.lit(" (edited)")))
                            .otherwise(F.col("payload"))))
    v = ledger.ledger_verify(tampered, TEST_KEY, "user_id", "event_id", "payload")
    return ledger.verify_summary(v, "user_id")


ORACLE_EVENT_CHECKSUM = """SELECT event_id, sha256(concat('outputs/', event_type, '/', CAST(user_id AS VARCHAR), '.json')) AS checksum
FROM events"""


@register("event_checksum", ORACLE_EVENT_CHECKSUM)
def q_event_checksum(spark, sf_dir):
    """SHA-256 of each event's artifact path string."""
    views(spark, sf_dir, "events")
    e = spark.table("events")
    path = F.concat(F.lit("outputs/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(".json"))
    return e.select("event_id", ledger.event_checksum(path).alias("checksum"))


ORACLE_TENANT_STATS = f"""WITH s AS ({SCORING_LOG})
SELECT tenant_id, count(*) AS predictions, round(coalesce(count(*) FILTER (WHERE high_risk) * 100.0 / count(*), 0), 1) AS high_risk_pct,
       round(coalesce(avg(probability), 0), 4) AS mean_probability
FROM s WHERE event_type IN ('PREDICTION', 'FHIR_PREDICTION') GROUP BY tenant_id"""


def _log(spark, sf_dir):
    return fixture(spark, sf_dir, SCORING_LOG, "events")


@register("tenant_stats", ORACLE_TENANT_STATS)
def q_tenant_stats(spark, sf_dir):
    """Prediction counts, high-risk share and mean probability per tenant."""
    return ledger.tenant_stats(_log(spark, sf_dir), "tenant_id", "event_type", "probability", "high_risk")


ORACLE_AUDIT_TAIL = f"""WITH s AS ({SCORING_LOG}) SELECT * FROM s WHERE tenant_id = '1' ORDER BY seq DESC LIMIT 150"""


@register("audit_tail", ORACLE_AUDIT_TAIL)
def q_audit_tail(spark, sf_dir):
    """Last 150 log entries of one tenant, newest first (the limit is the feature)."""
    return ledger.audit_tail(ledger.tenant_scope(_log(spark, sf_dir), "tenant_id", "1"), "seq", 150)


ORACLE_LOOKUP = f"""WITH s AS ({SCORING_LOG})
SELECT tenant_id, request_id, min(seq) AS first_seq FROM s GROUP BY tenant_id, request_id"""


@register("assessment_lookup", ORACLE_LOOKUP)
def q_lookup(spark, sf_dir):
    """First log entry per (tenant, request id), rendered as a JSON document;
    the check reads the sequence number back out of the document."""
    d = _log(spark, sf_dir).select("tenant_id", "request_id", "seq", "event_type", "probability", "high_risk",
                                   F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    return ledger.assessment_lookup(d, ["tenant_id", "request_id"], "seq").select(
        "tenant_id", "request_id", F.get_json_object("document", "$.seq").cast("long").alias("first_seq"))


ORACLE_PRED_SUMMARY = f"""WITH s AS ({SCORING_LOG})
SELECT count(*) AS total, count(*) FILTER (WHERE high_risk) AS high, count(*) FILTER (WHERE NOT high_risk) AS low
FROM s WHERE contains(event_type, 'PREDICTION')"""


@register("prediction_summary", ORACLE_PRED_SUMMARY)
def q_pred_summary(spark, sf_dir):
    """Total / high / low over prediction events."""
    return ledger.prediction_summary(_log(spark, sf_dir), "event_type", "high_risk")


ORACLE_EVENT_DISPLAY = """SELECT replace(substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 1, 19), 'T', ' ') AS time, event_id, event_type,
       substr(to_json({'user_id': user_id, 'value': value, 'props': props}), 1, 100) AS details FROM events"""


@register("event_display", ORACLE_EVENT_DISPLAY)
def q_event_display(spark, sf_dir):
    """Display projection of the event log."""
    views(spark, sf_dir, "events")
    return ledger.event_display(spark.table("events"), "ts", ["event_id", "event_type"], ["user_id", "value", "props"])


SEVERITY_EVENTS = """
SELECT event_id, upper(event_type) AS event_type,
       CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END
         AS severity
FROM events
"""

ORACLE_ALERTS = f"""WITH s AS ({SEVERITY_EVENTS}),
o AS (SELECT *, row_number() OVER (PARTITION BY severity, event_type ORDER BY event_id) AS occurrence,
             CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 10 ELSE 99 END AS threshold FROM s)
SELECT event_id, severity, event_type, occurrence, threshold, occurrence >= threshold AS alert_triggered,
       CASE WHEN occurrence >= threshold THEN 'Log and monitor' END AS response FROM o"""


@register("alert_threshold", ORACLE_ALERTS)
def q_alerts(spark, sf_dir):
    """Occurrence counts and threshold alerts per (severity, event type), in event order."""
    s = fixture(spark, sf_dir, SEVERITY_EVENTS, "events")
    return alerts.alert_threshold(s, "severity", "event_type", "event_id").select(
        "event_id", "severity", "event_type", F.col("occurrence").cast("long"), "threshold", "alert_triggered",
        "response")


QUARANTINE_LOG = """
SELECT event_id AS seq, concat('model_', CAST(user_id % 20 AS STRING), '.pkl') AS artifact,
       CASE event_type WHEN 'error' THEN 'QUARANTINE' WHEN 'purchase' THEN 'APPROVE' ELSE 'NOTE' END AS action
FROM events
"""

ORACLE_QUARANTINE = f"""WITH q AS ({QUARANTINE_LOG})
SELECT artifact, arg_max(action, seq) FILTER (WHERE action IN ('QUARANTINE', 'APPROVE')) AS last_action,
       count(*) FILTER (WHERE action = 'QUARANTINE') AS quarantines,
       coalesce(arg_max(action, seq) FILTER (WHERE action IN ('QUARANTINE', 'APPROVE')) = 'APPROVE', false) AS approved,
       count(*) FILTER (WHERE action = 'QUARANTINE') = 0
         OR arg_max(action, seq) FILTER (WHERE action IN ('QUARANTINE', 'APPROVE')) = 'APPROVE' AS safe_to_deploy
FROM q GROUP BY artifact"""


@register("quarantine_state", ORACLE_QUARANTINE)
def q_quarantine(spark, sf_dir):
    """Latest quarantine / approval state per artifact."""
    return alerts.quarantine_state(fixture(spark, sf_dir, QUARANTINE_LOG, "events"), "artifact", "action", "seq")


def _vitals(spark, sf_dir):
    return fixture(spark, sf_dir, fx.VITALS, "customer")


_SCORE_SQL = """least(greatest(0.1 + age / 100.0 + (ap_hi + ap_lo - 120.0) / 100.0 + cholesterol * 0.15 + gluc * 0.1
        + CASE WHEN active = 0 THEN 0.1 ELSE 0.0 END + CASE WHEN smoke = 1 THEN 0.12 ELSE 0.0 END, 0.05), 0.95)"""

ORACLE_HEURISTIC = f"""WITH v AS ({fx.VITALS})
SELECT patient_id, round({_SCORE_SQL}, 6) AS score,
       CASE WHEN {_SCORE_SQL} >= 0.7 THEN 'HIGH' WHEN {_SCORE_SQL} >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS band FROM v"""


@register("heuristic_score", ORACLE_HEURISTIC)
def q_heuristic(spark, sf_dir):
    """Closed-form fallback probability and its bands for every patient row."""
    v = _vitals(spark, sf_dir)
    s = score.heuristic_score()
    return v.select("patient_id", F.round(s, 6).alias("score"), score.heuristic_band(s).alias("band"))


# a probability with spread: scaled account balance (the vitals formula saturates)
_PROB_SQL = "least(greatest((c_acctbal + 1000.0) / 11000.0, 0.0), 1.0)"

ORACLE_RISK_BAND = f"""WITH v AS ({fx.VITALS}), p AS (SELECT patient_id, {_PROB_SQL} AS prob FROM v)
SELECT patient_id, prob, CASE WHEN prob >= 0.75 THEN 'HIGH' WHEN prob >= 0.55 THEN 'MODERATE-HIGH'
       WHEN prob >= 0.40 THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
       CASE WHEN prob >= 0.65 THEN '#e74c3c' WHEN prob >= 0.45 THEN '#e67e22' ELSE '#27ae60' END AS colour,
       CASE WHEN prob >= 0.75 THEN 'HIGH RISK' WHEN prob >= 0.55 THEN 'MODERATE-HIGH' WHEN prob >= 0.40 THEN 'MODERATE'
            ELSE 'LOW RISK' END AS label,
       CASE WHEN prob >= 0.55 THEN 'high' WHEN prob >= 0.40 THEN 'moderate' ELSE 'low' END AS class FROM p"""


def _prob():
    return F.least(F.greatest((F.col("c_acctbal") + 1000.0) / 11000.0, F.lit(0.0)), F.lit(1.0))


@register("risk_band", ORACLE_RISK_BAND)
def q_risk_band(spark, sf_dir):
    """Service bands and dashboard colour / class bands of a probability column."""
    v = _vitals(spark, sf_dir).withColumn("prob", _prob())
    colour, label, klass = score.dashboard_bands("prob")
    return v.select("patient_id", "prob", score.risk_band("prob").alias("risk_level"), colour.alias("colour"),
                    label.alias("label"), klass.alias("class"))


_BMI = "(weight / ((height / 100.0) * (height / 100.0)))"
_FACTORS_SQL = f"""list_filter([
  CASE WHEN ap_hi >= 140 THEN 'Systolic BP|' || CAST(ap_hi AS VARCHAR) || ' mmHg' END,
  CASE WHEN ap_lo >= 90 THEN 'Diastolic BP|' || CAST(ap_lo AS VARCHAR) || ' mmHg' END,
  CASE WHEN cholesterol = 3 THEN 'Cholesterol|Well above normal' END,
  CASE WHEN cholesterol = 2 THEN 'Cholesterol|Above normal' END,
  CASE WHEN smoke = 1 THEN 'Smoking|Active smoker' END,
  CASE WHEN gluc >= 2 THEN 'Glucose|Elevated' END,
  CASE WHEN {_BMI} >= 30 THEN 'BMI|' || printf('%.1f', {_BMI}) || ' (Obese)' END,
  CASE WHEN {_BMI} >= 25 AND {_BMI} < 30 THEN 'BMI|' || printf('%.1f', {_BMI}) || ' (Overweight)' END,
  CASE WHEN active = 0 THEN 'Physical Activity|Sedentary' END,
  CASE WHEN age >= 60 THEN 'Age|' || CAST(CAST(trunc(age) AS INTEGER) AS VARCHAR) || ' years' END], lambda x: x IS NOT NULL)"""

ORACLE_RISK_FACTORS = f"""WITH v AS ({fx.VITALS}), f AS (SELECT patient_id, {_FACTORS_SQL} AS l FROM v)
SELECT patient_id, (CASE WHEN len(l) > 0 THEN l ELSE ['Profile|No major risk factors identified'] END)[1:6] AS factors FROM f"""


@register("risk_factors", ORACLE_RISK_FACTORS)
def q_risk_factors(spark, sf_dir):
    """Ordered rule-based risk factors (first six) for every patient row."""
    v = _vitals(spark, sf_dir)
    return v.select("patient_id", F.transform(score.risk_factors(), lambda x: F.concat_ws("|", x["factor"], x["value"]))
                    .alias("factors"))


ORACLE_FACTOR_STATUS = f"""WITH v AS ({fx.VITALS})
SELECT patient_id, 'Systolic BP' AS measure, ap_hi AS value, CASE WHEN ap_hi >= 140 THEN 'HIGH' WHEN ap_hi >= 130 THEN 'ELEVATED' ELSE 'NORMAL' END AS status FROM v
UNION ALL SELECT patient_id, 'Diastolic BP', ap_lo, CASE WHEN ap_lo >= 90 THEN 'HIGH' WHEN ap_lo >= 80 THEN 'ELEVATED' ELSE 'NORMAL' END FROM v
UNION ALL SELECT patient_id, 'BMI', {_BMI}, CASE WHEN {_BMI} >= 30 THEN 'HIGH' WHEN {_BMI} >= 25 THEN 'ELEVATED' ELSE 'NORMAL' END FROM v
UNION ALL SELECT patient_id, 'Pulse Pressure', ap_hi - ap_lo, CASE WHEN ap_hi - ap_lo >= 60 THEN 'HIGH' WHEN ap_hi - ap_lo >= 50 THEN 'ELEVATED' ELSE 'NORMAL' END FROM v"""


@register("factor_status", ORACLE_FACTOR_STATUS)
def q_factor_status(spark, sf_dir):
    """NORMAL / ELEVATED / HIGH grid of four measures per patient (long form)."""
    return score.factor_status(_vitals(spark, sf_dir), "patient_id")


ORACLE_RECOMMENDATION = f"""WITH v AS ({fx.VITALS}), p AS (SELECT *, {_PROB_SQL} AS prob FROM v)
SELECT patient_id, CASE
  WHEN prob >= 0.75 THEN 'URGENT: High CVD risk detected. Recommend immediate cardiology referral, '
       || coalesce(nullif(array_to_string(list_filter([CASE WHEN ap_hi >= 140 THEN 'hypertension management' END,
              CASE WHEN cholesterol >= 2 THEN 'lipid-lowering therapy' END, CASE WHEN smoke = 1 THEN 'smoking cessation program' END,
              CASE WHEN active = 0 THEN 'supervised exercise program' END], lambda x: x IS NOT NULL), ', '), ''),
              'comprehensive cardiovascular workup') || '. Follow Australian Heart Foundation guidelines.'
  WHEN prob >= 0.55 THEN 'ELEVATED RISK: Schedule cardiology consultation within 4 weeks. Monitor blood pressure, cholesterol, and lifestyle factors. Consider preventive medication per NHFA guidelines.'
  WHEN prob >= 0.40 THEN 'BORDERLINE: Annual cardiovascular screening recommended. Lifestyle modification advised: diet, exercise, smoking cessation if applicable.'
  ELSE 'LOW RISK: Continue routine health monitoring. Annual check-up with GP. Maintain healthy lifestyle.' END AS recommendation
FROM p"""


@register("recommendation", ORACLE_RECOMMENDATION)
def q_recommendation(spark, sf_dir):
    """Recommendation text by band, listing applicable actions for HIGH."""
    v = _vitals(spark, sf_dir).withColumn("prob", _prob())
    return v.select("patient_id", score.recommendation("prob").alias("recommendation"))


ORACLE_VALIDATE = f"""WITH v AS (SELECT *, CASE WHEN patient_id % 9 = 0 THEN 300.0 ELSE ap_hi END AS ap_hi2,
                                       CASE WHEN patient_id % 11 = 0 THEN 0 ELSE gender END AS gender2 FROM ({fx.VITALS}) x)
SELECT patient_id, list_filter([
  CASE WHEN NOT coalesce(age BETWEEN 1 AND 120, false) THEN 'age_range' END,
  CASE WHEN NOT coalesce(gender2 BETWEEN 1 AND 2, false) THEN 'gender_range' END,
  CASE WHEN NOT coalesce(height BETWEEN 100 AND 250, false) THEN 'height_range' END,
  CASE WHEN NOT coalesce(weight BETWEEN 20 AND 300, false) THEN 'weight_range' END,
  CASE WHEN NOT coalesce(ap_hi2 BETWEEN 60 AND 250, false) THEN 'ap_hi_range' END,
  CASE WHEN NOT coalesce(ap_lo BETWEEN 40 AND 180, false) THEN 'ap_lo_range' END,
  CASE WHEN NOT coalesce(ap_hi2 > ap_lo, false) THEN 'ap_hi_gt_ap_lo' END], lambda x: x IS NOT NULL) AS violations
FROM v"""


@register("validate_rows", ORACLE_VALIDATE)
def q_validate(spark, sf_dir):
    """Range and cross-field rule violations per record (a few records out of range)."""
    v = _vitals(spark, sf_dir)
    v = (v.withColumn("ap_hi", F.when(F.col("patient_id") % 9 == 0, F.lit(300.0)).otherwise(F.col("ap_hi")))
         .withColumn("gender", F.when(F.col("patient_id") % 11 == 0, F.lit(0)).otherwise(F.col("gender"))))
    ranges = {k: score.INPUT_RANGES[k] for k in ["age", "gender", "height", "weight", "ap_hi", "ap_lo"]}
    return score.validate_rows(v.select("patient_id", *ranges.keys()), ranges).select("patient_id", "violations")


ORACLE_BATCH = f"""WITH v AS ({fx.VITALS}), p AS (SELECT *, {_PROB_SQL} AS prob FROM v)
SELECT patient_id, prob AS probability, CAST(prob >= 0.5 AS INTEGER) AS prediction,
       CASE WHEN prob >= 0.75 THEN 'HIGH' WHEN prob >= 0.55 THEN 'MODERATE-HIGH' WHEN prob >= 0.40 THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
       least(len(list_filter([ap_hi >= 140, ap_lo >= 90, cholesterol >= 2, smoke = 1, gluc >= 2, {_BMI} >= 25, active = 0,
                              age >= 60], lambda x: x)), 6) AS n_factors
FROM p"""


@register("batch_score", ORACLE_BATCH)
def q_batch(spark, sf_dir):
    """Validate -> probability -> band -> factors for every patient (no batch cap)."""
    v = _vitals(spark, sf_dir)
    s = score.batch_score(v, prob=_prob())
    return s.select("patient_id", "probability", "prediction", "risk_level",
                    F.size(F.filter("top_risk_factors", lambda x: x["factor"] != "Profile")).alias("n_factors"))


FHIR_BUNDLES = """
SELECT c_custkey AS bundle_id, concat(
  '{"resourceType": "Bundle", "type": "collection", "entry": [',
  '{"resource": {"resourceType": "Patient", "id": "', CAST(c_custkey AS STRING), '", "gender": "',
      CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END, '", "birthDate": "',
      CAST(1940 + c_custkey % 50 AS STRING), '-06-15"}},',
  '{"resource": {"resourceType": "Observation", "code": {"coding": [{"system": "http://loinc.org", "code": "85354-9"}]},',
      ' "component": [{"code": {"coding": [{"code": "8480-6"}]}, "valueQuantity": {"value": ',
      CAST(100 + (c_custkey * 7) % 90 AS STRING), ', "unit": "mmHg"}},',
      ' {"code": {"coding": [{"code": "8462-4"}]}, "valueQuantity": {"value": ',
      CAST(60 + (c_custkey * 3) % 50 AS STRING), ', "unit": "mmHg"}}]}},',
  '{"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "2093-3"}]}, "valueQuantity": {"value": ',
      CAST(150 + c_custkey % 120 AS STRING), '}}},',
  '{"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "72166-2"}]}, "valueCodeableConcept": {"text": "',
      CASE WHEN c_nationkey % 3 = 0 THEN 'Current smoker' WHEN c_nationkey % 3 = 1 THEN 'Non-smoker' ELSE 'Never' END,
      '"}}}]}') AS bundle
FROM customer
"""


# What the rendered bundles say, straight from the customer columns.
ORACLE_FHIR = """SELECT c_custkey AS bundle_id,
  round(date_diff('day', make_date(CAST(1940 + c_custkey % 50 AS INTEGER), 6, 15), DATE '2025-01-01') / 365.25, 4) AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS gender, 168.0 AS height, 72.0 AS weight,
  CAST(100 + (c_custkey * 7) % 90 AS DOUBLE) AS ap_hi, CAST(60 + (c_custkey * 3) % 50 AS DOUBLE) AS ap_lo,
  CASE WHEN 150 + c_custkey % 120 >= 240 THEN 3 WHEN 150 + c_custkey % 120 >= 200 THEN 2 ELSE 1 END AS cholesterol,
  1 AS gluc, CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END AS smoke, 0 AS alco, 1 AS active FROM customer"""


@register("fhir_vitals", ORACLE_FHIR)
def q_fhir(spark, sf_dir):
    """One vitals row per FHIR bundle (bundles rendered from customer rows)."""
    b = fixture(spark, sf_dir, FHIR_BUNDLES, "customer")
    return fhir.fhir_vitals(b, "bundle_id", "bundle", as_of="2025-01-01").drop("patient_ref", "observations")


ORACLE_FHIR_RA = f"""WITH v AS ({ORACLE_FHIR}), p AS (SELECT *, round({_SCORE_SQL}, 4) AS prob, {_SCORE_SQL} AS raw FROM v)
SELECT bundle_id, 'RiskAssessment' AS resource_type, 'final' AS status, 'Patient/' || bundle_id AS subject,
  '2025-01-01T00:00:00+00:00' AS occurred, 'Cardiovascular Disease (10-year risk)' AS outcome, prob AS probability,
  CASE WHEN raw >= 0.75 THEN 'HIGH' WHEN raw >= 0.55 THEN 'MODERATE-HIGH' WHEN raw >= 0.40 THEN 'MODERATE' ELSE 'LOW' END
    || ' risk of CVD' AS display, 10 AS years, 3 AS observations,
  'Observation/unknown' AS basis, 3 AS notes FROM p"""


@register("fhir_risk_assessment", ORACLE_FHIR_RA)
def q_fhir_ra(spark, sf_dir):
    """FHIR bundles -> vitals -> closed-form score -> RiskAssessment JSON, read back field by field."""
    b = fixture(spark, sf_dir, FHIR_BUNDLES, "customer")
    s = score.batch_score(fhir.fhir_vitals(b, "bundle_id", "bundle", as_of="2025-01-01"))
    doc = fhir.fhir_risk_assessment(s, "2025-01-01T00:00:00+00:00")
    get = lambda path: F.get_json_object("risk_assessment", path)
    one = "$.prediction[0]"
    return doc.select(
        "bundle_id", get("$.resourceType").alias("resource_type"), get("$.status").alias("status"),
        get("$.subject.reference").alias("subject"), get("$.occurrenceDateTime").alias("occurred"),
        get(f"{one}.outcome.text").alias("outcome"), get(f"{one}.probabilityDecimal").cast("double").alias("probability"),
        get(f"{one}.qualitativeRisk.coding[0].display").alias("display"),
        get(f"{one}.whenRange.high.value").cast("int").alias("years"),
        F.json_array_length(get("$.basis")).alias("observations"), get("$.basis[0].reference").alias("basis"),
        F.json_array_length(get("$.note")).alias("notes"))


ORACLE_PATIENTS = """SELECT c_custkey AS source_key, CASE WHEN c_custkey % 4 = 0
  THEN substr(sha256('{"resourceType":"Patient","name":"' || c_name || '"}'), 1, 8) ELSE 'p' || c_custkey END AS patient_id FROM customer"""


@register("patient_ingest", ORACLE_PATIENTS)
def q_patients(spark, sf_dir):
    """Patient ids of customer-derived Patient resources: the given id, or one derived from the document."""
    d = fixture(spark, sf_dir, """SELECT c_custkey AS source_key, CASE WHEN c_custkey % 4 <> 0 THEN concat('p', CAST(c_custkey AS STRING)) END AS id,
        concat('{"resourceType":"Patient","name":"', c_name, '"}') AS raw FROM customer""", "customer")
    return d.select("source_key", fhir.patient_id("id", "raw").alias("patient_id"))


# Artifact files of a run, as an event log names them: an artifact exists if its event was seen, with that many bytes.
ARTIFACTS = """
SELECT e.artifact, s.size_bytes FROM VALUES ('dataset_catalog.json', 'view'), ('eda_report.html', 'click'),
  ('shap_report.html', 'purchase'), ('lime_report.html', 'signup'), ('guardrail_report.json', 'error'),
  ('model_card.json', 'no such event') AS e(artifact, event_type)
LEFT JOIN (SELECT event_type, sum(length(props)) AS size_bytes FROM events GROUP BY event_type) s ON s.event_type = e.event_type
"""

_ARTIFACTS_DUCK = ARTIFACTS.replace("FROM VALUES", "FROM (VALUES").replace("'no such event') AS e", "'no such event')) AS e")

ORACLE_INVENTORY = f"""SELECT artifact, size_bytes IS NOT NULL AS "exists", coalesce(CAST(size_bytes AS BIGINT), 0) AS size_bytes
FROM ({_ARTIFACTS_DUCK}) a"""


def _inventory(spark, sf_dir):
    from riskframe.sources import files
    made = fixture(spark, sf_dir, ARTIFACTS, "events")
    return files.inventory_of(made.select("artifact"), made.where("size_bytes IS NOT NULL"))


@register("artifact_inventory", ORACLE_INVENTORY)
def q_inventory(spark, sf_dir):
    """Expected artifacts against those that the event log has made: existence and size."""
    return _inventory(spark, sf_dir)


@register("file_sha256")
def q_file_sha(spark, sf_dir):
    """SHA-256 of every parquet file's bytes in the data folder."""
    from riskframe.sources import files
    return files.file_sha256(spark, sf_dir, "*.parquet")


ORACLE_RELEASE = f"""WITH g AS ({{gate}}), i AS ({ORACLE_INVENTORY}),
x AS (SELECT count(*) AS artifacts, count(*) FILTER (WHERE "exists") AS present FROM i),
m AS (SELECT passed, leakage, present, artifacts, list_filter([
    CASE WHEN (SELECT "exists" FROM i WHERE artifact = 'dataset_catalog.json') THEN 'All datasets validated' END,
    CASE WHEN (SELECT "exists" FROM i WHERE artifact = 'eda_report.html') THEN 'EDA completed' END,
    CASE WHEN passed THEN 'Best model selected' END,
    CASE WHEN (SELECT "exists" FROM i WHERE artifact = 'shap_report.html') THEN 'SHAP completed' END,
    CASE WHEN (SELECT "exists" FROM i WHERE artifact = 'lime_report.html') THEN 'LIME completed' END,
    CASE WHEN (SELECT "exists" FROM i WHERE artifact = 'guardrail_report.json') THEN 'Security review passed' END],
    lambda c: c IS NOT NULL) AS met FROM g, x),
v AS (SELECT *, CASE WHEN leakage THEN 'REJECTED' WHEN passed AND present = artifacts THEN 'APPROVED' ELSE 'CONDITIONAL' END AS verdict FROM m)
SELECT passed, leakage, present, artifacts, met, len(met) AS criteria_met, 6 AS criteria_total, verdict,
  CASE verdict WHEN 'REJECTED' THEN 'REJECTED — Data leakage detected. Re-run Agent 3 then Agent 6.'
    WHEN 'APPROVED' THEN 'APPROVED FOR DEPLOYMENT' ELSE 'CONDITIONAL — Review flagged items before deployment' END AS recommendation
FROM v""".replace("{gate}", q_metrics.ORACLE_GATE)


@register("release_verdict", ORACLE_RELEASE)
def q_release(spark, sf_dir):
    """Release verdict from the model gate and the artifact inventory."""
    return alerts.release_verdict(q_metrics.q_gate(spark, sf_dir), _inventory(spark, sf_dir), alerts.RELEASE_CRITERIA,
                                  alerts.RELEASE_TEXTS)
