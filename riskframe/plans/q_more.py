"""Registered queries of the advisory texts, the JSON log path, checksums, input
mapping and small summaries (R-5, R-6, S-5, S-7, S-9, L-4, J-3, B-7, B-8, B-12, D-23, Q-3, Q-4, M-18, X-5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.operators import advisory, alerts, clean, features, graph, ledger, train
from riskframe.operators.text import tfidf_search
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.q_text import ORACLE_NEIGHBORS, ORACLE_TFIDF, ORACLE_VERDICT
from riskframe.plans.q_train import _PHI_SQL, _attributions
from riskframe.plans.registry import fixture, register, views
from riskframe.session import checkpoint_path
from riskframe.sources import files

COMPILED = "2025-01-01 00:00:00 UTC"

# Whole texts of the benchmark, each with a topic word; documents are the guideline sections.
QUESTIONS = """SELECT item_id, concat(CASE item_id % 4 WHEN 0 THEN 'Blood pressure: ' WHEN 1 THEN 'Lipid: ' WHEN 2 THEN 'Alcohol: '
  ELSE '' END, text) AS question FROM benchmark"""

_EVIDENCE_SQL = """CASE
 WHEN contains(q, 'bp') OR contains(q, 'blood pressure') OR contains(q, 'hypertension') THEN
  '> **From National Heart Foundation of Australia (NHFA) Guidelines:**' || chr(10) || '> Normal blood pressure is <120/80 mmHg. Grade 2 Hypertension is defined as BP >=140/90 mmHg. Immediate pharmacological therapy is recommended for all patients with BP >=140/90 mmHg or those with Grade 1 Hypertension and high absolute cardiovascular disease risk.'
 WHEN contains(q, 'cholesterol') OR contains(q, 'lipid') THEN
  '> **From National Heart Foundation of Australia (NHFA) Guidelines:**' || chr(10) || '> Desirable total cholesterol is <5.0 mmol/L. For patients identified as high absolute risk, lipid-lowering pharmacotherapy (Statins) should be initiated to target an LDL-C reduction of >=50% or target LDL-C <1.8 mmol/L.'
 ELSE '> Guideline: Implement lifestyle modifications including sodium restriction (<2g/day), regular cardiovascular exercise (30 mins/day), and smoking cessation programs for general CVD risk mitigation.' END"""

_ADVICE_SQL = """CASE
 WHEN contains(q, 'bp') OR contains(q, 'blood pressure') OR contains(q, 'hypertension') THEN
  '1. **Diagnostic Validation:** Confirm blood pressure measurements across multiple visits unless severe (>=180/110 mmHg).' || chr(10) || '2. **Therapeutic Action:** Introduce lifestyle changes (reduced sodium, cardiovascular exercise) and first-line anti-hypertensive drugs (ACEi/ARB) for high-risk patients.'
 WHEN contains(q, 'cholesterol') OR contains(q, 'lipid') THEN
  '1. **Therapeutic Action:** Recommend high-intensity statin therapy (Atorvastatin 40-80mg or Rosuvastatin 20-40mg) for patients in high absolute risk category.' || chr(10) || '2. **Follow-up:** Re-check lipid profiles in 4-6 weeks to verify therapeutic compliance.'
 ELSE '1. **Absolute Risk Profiling:** Perform absolute CVD risk evaluation using demographic and physiological markers.' || chr(10) || '2. **Lifestyle Modification:** Advocate sodium reduction, healthy diet, and regular activity.' END"""

_SCORES_SQL = (ORACLE_TFIDF.replace("FROM benchmark)", "FROM questions)").replace("lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM questions",
                                                                                  "lower(question), '[\\p{L}\\p{N}_]{2,}')) AS term FROM questions")
               .replace("WITH\n", "").replace("rank <= 3 AND", "rank <= 2 AND"))

ORACLE_ADVISORY = f"""WITH questions AS ({QUESTIONS}),
scores AS (WITH {_SCORES_SQL}),
chunk AS (SELECT item_id, string_agg('> **Section from doc-' || doc_id || ':**' || chr(10) || '> ' || text || chr(10)
    || '> *(Relevance score: ' || CAST(score AS VARCHAR) || ')*' || chr(10), chr(10) ORDER BY rank) AS evidence
  FROM scores JOIN documents USING (doc_id) GROUP BY item_id),
link AS (SELECT item_id AS doc_id, question AS text FROM questions),
near AS ({ORACLE_NEIGHBORS.replace("(" + fx.DOCUMENTS_PLANTED + ")", "link")}),
rel AS (SELECT doc_id AS item_id, string_agg(CASE role
    WHEN 'target' THEN '- Relationship: `' || node || '` is impacted by query topic (Relationship type: *' || relationship || '*). Description: *' || description || '*'
    ELSE '- Relationship: Query topic is impacted by `' || node || '` (Relationship type: *' || relationship || '*). Description: *' || description || '*' END,
    chr(10) ORDER BY ord, epos) FILTER (WHERE role <> 'subject') AS relations,
  max(chr(10) || '*Query topic definition:* **' || node || '** (' || type || '): ' || description || chr(10)) FILTER (WHERE role = 'subject') AS subject
  FROM near GROUP BY doc_id),
x AS (SELECT item_id, question, lower(question) AS q, evidence, relations, subject
      FROM questions LEFT JOIN chunk USING (item_id) LEFT JOIN rel USING (item_id))
SELECT item_id, array_to_string(['### 🏥 CLINICAL ADVISORY REPORT', '*Compiled on: {COMPILED}*', '*Clinician Query: "' || question || '"*' || chr(10),
  '#### 📖 Retrieved Guideline Evidence:', coalesce(evidence, {_EVIDENCE_SQL}),
  chr(10) || '#### 🔬 Clinical Graph Relationships:',
  CASE WHEN subject IS NULL THEN '- No specific graph relations found. Normal physiological pathways apply.'
       ELSE 'We identified the following anatomical/physiological relationships for your query:' || coalesce(chr(10) || relations, '') || chr(10) || subject END,
  chr(10) || '#### 💡 Evidence-based Recommendations:', {_ADVICE_SQL},
  chr(10) || '> [!NOTE]', '> This advice is synthesized from Australian Clinical Guidelines (NHFA) for cardiovascular management. Clinical judgement must override automated summaries.'], chr(10)) AS report FROM x"""


def _reports(spark, sf_dir):
    q = fixture(spark, sf_dir, QUESTIONS, "benchmark")
    views(spark, sf_dir, "documents")
    docs = spark.table("documents").select("doc_id", "text")
    hits = tfidf_search(docs, "doc_id", "text", q, "item_id", "question", top_k=2).join(docs, "doc_id")
    chunk = F.struct("rank", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), "text", "score")
    chunks = hits.groupBy("item_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))  # at most two a question
    nodes, edges = graph.clinical_graph(spark)
    linked = q.select("item_id", graph.keyword_node("question").alias("node")).where("node IS NOT NULL")
    near = graph.graph_neighbors(linked, "node", nodes, edges)
    entry = F.struct("ord", "epos", "node", "role", "type", "relationship", "description")
    nbrs = near.groupBy("item_id").agg(F.array_sort(F.collect_list(entry)).alias("nodes"))  # one node's neighbours
    rows = q.join(chunks, "item_id", "left").join(nbrs, "item_id", "left")
    return rows.select("item_id", advisory.advisory_report("question", "chunks", "nodes", COMPILED).alias("report"))


@register("advisory_report", ORACLE_ADVISORY)
def q_advisory(spark, sf_dir):
    """Advisory report of every benchmark question: two best documents, graph neighbours, advice."""
    return _reports(spark, sf_dir)


ORACLE_GUARDED = f"""WITH reports AS ({ORACLE_ADVISORY}), d0 AS (SELECT item_id AS doc_id, report AS text FROM reports),
v AS ({ORACLE_VERDICT.replace("(" + fx.DOCUMENTS_PLANTED + ")", "(SELECT * FROM d0)")})
SELECT doc_id AS item_id, safe, CASE WHEN safe THEN text ELSE
  '[BLOCKED BY CLINICAL GUARDRAIL] The generated advice failed safety checks. Reason: ' || reason END AS answer,
  CASE WHEN safe THEN ['National Heart Foundation of Australia (NHFA) Guidelines for Hypertension Management',
    'NHFA Guidelines for Lipid and Cholesterol Management'] ELSE [] END AS sources FROM v JOIN d0 USING (doc_id)"""


@register("guarded_answer", ORACLE_GUARDED)
def q_guarded(spark, sf_dir):
    """Every advisory report after the guard's verdict: the text or the reason it is blocked."""
    g = advisory.guarded_answer(_reports(spark, sf_dir))
    return g.select("item_id", "safe", "answer", F.transform("sources", lambda s: s["title"]).alias("sources"))


# Log lines: one per event, some blank, cut or without a type.
LOG_LINES = """SELECT event_id, CASE WHEN event_id % 23 = 0 THEN '  '
  WHEN event_id % 19 = 0 THEN '{"timestamp": "t'
  WHEN event_id % 17 = 0 THEN concat('{"timestamp": "', CAST(event_id AS STRING), '", "value": 1}')
  ELSE concat('{"timestamp": "', CAST(event_id AS STRING), '", "event_type": "', event_type, '", "value": ', CAST(user_id AS STRING), '}') END AS line
FROM events"""


@register("jsonl_scan", f"""WITH l AS ({LOG_LINES})
SELECT event_id, json_extract_string(line, '$.timestamp') AS "timestamp", json_extract_string(line, '$.event_type') AS event_type,
       CAST(json_extract_string(line, '$.value') AS BIGINT) AS value FROM l WHERE json_valid(line)""")
def q_jsonl(spark, sf_dir):
    """The log lines that parse, typed."""
    good, _ = files.jsonl_lines(fixture(spark, sf_dir, LOG_LINES, "events"), "line", "timestamp string, event_type string, value long")
    return good


@register("jsonl_rejects", f"WITH l AS ({LOG_LINES}) SELECT event_id, line AS raw FROM l WHERE trim(line) <> '' AND NOT json_valid(line)")
def q_jsonl_rejects(spark, sf_dir):
    """The log lines that do not parse."""
    return files.jsonl_lines(fixture(spark, sf_dir, LOG_LINES, "events"), "line", "timestamp string")[1]


@register("log_validity", f"""WITH l AS ({LOG_LINES}) SELECT event_id, json_valid(line) AS is_json,
  json_valid(line) AND contains(line, '"event_type"') AS valid FROM l WHERE trim(line) <> ''""")
def q_log_validity(spark, sf_dir):
    """Which log lines are JSON with a timestamp and a type or event type."""
    lines = fixture(spark, sf_dir, LOG_LINES, "events")
    return files.log_validity(lines, "line", [["timestamp"], ["type", "event_type"]]).drop("line")


@register("json_documents", """SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS document
FROM orders""")
def q_json_documents(spark, sf_dir):
    """Each order as one JSON document."""
    views(spark, sf_dir, "orders")
    return files.json_documents(spark.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


@register("verify_checksums", """SELECT o_orderkey AS artifact, CASE WHEN o_orderkey % 31 = 0 THEN 'MISSING' WHEN o_orderkey % 37 = 0 THEN 'UNEXPECTED'
  WHEN o_orderkey % 29 = 0 THEN 'TAMPERED' ELSE 'MATCH' END AS status FROM orders WHERE NOT (o_orderkey % 31 = 0 AND o_orderkey % 37 = 0)""")
def q_verify_checksums(spark, sf_dir):
    """A manifest of order checksums against recomputed ones, with changed, missing and unlisted orders."""
    views(spark, sf_dir, "orders")
    body = F.concat_ws("|", "o_custkey", "o_orderstatus")
    o = spark.table("orders").select(F.col("o_orderkey").alias("artifact"), body.alias("body"))
    manifest = o.where("artifact % 37 <> 0").select("artifact", ledger.event_checksum("body").alias("expected"))
    seen = F.when(F.col("artifact") % 29 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    actual = o.where("artifact % 31 <> 0").select("artifact", ledger.event_checksum(seen).alias("actual"))
    return ledger.verify_checksums(manifest, actual).select("artifact", "status")


_FEATURES = ["age", "gender", "height", "ap_hi", "bmi", "pulse_pressure", "age_decade", "not_known"]


@register("feature_row", f"""WITH v AS ({fx.VITALS}) SELECT patient_id, round((age * 365.25 - 20000.0) / 2500.0, 6) AS age, CAST(gender AS DOUBLE) AS gender,
  height, ap_hi, round(weight / ((height / 100.0) * (height / 100.0)), 6) AS bmi, ap_hi - ap_lo AS pulse_pressure, floor(age / 10) AS age_decade,
  0.0 AS not_known FROM v""")
def q_feature_row(spark, sf_dir):
    """Patients mapped to the columns of a fitted model (vitals schema, age scaled)."""
    v = fixture(spark, sf_dir, fx.VITALS, "customer")
    r = features.feature_row(v, _FEATURES, "patient_id", {"age": (20000.0, 2500.0)})
    return r.withColumns({"age": F.round("age", 6), "bmi": F.round("bmi", 6)})


@register("feature_row_survey", f"""WITH v AS ({fx.VITALS}) SELECT patient_id, CASE WHEN gender = 2 THEN 1.0 ELSE 0.0 END AS sex, ap_hi AS sbp_avg,
  CASE gluc WHEN 1 THEN 95.0 WHEN 2 THEN 125.0 ELSE 180.0 END AS bg_mgdl, 1.0 AS education, 0.0 AS bplt, age FROM v""")
def q_feature_row_survey(spark, sf_dir):
    """Patients mapped to the columns of a fitted model (survey schema)."""
    v = fixture(spark, sf_dir, fx.VITALS, "customer")
    return features.feature_row(v, ["sex", "sbp_avg", "bg_mgdl", "education", "bplt", "age"], "patient_id")


@register("batch_summary", """SELECT user_id % 50 AS request, count(*) AS batch_size, count(*) FILTER (WHERE event_type = 'purchase') AS high_risk_count,
  count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id % 50""")
def q_batch_summary(spark, sf_dir):
    """Size, high-risk rows and errors of each scoring request."""
    d = fixture(spark, sf_dir, """SELECT user_id % 50 AS request, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS prediction,
        CASE WHEN event_type = 'error' THEN props END AS error FROM events""", "events")
    return ledger.batch_summary(d, "request", "prediction", "error")


@register("score_router", """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'blocked' WHEN (o_orderkey % 101) / 100.0 >= 0.9 THEN 'approved'
  WHEN (o_orderkey % 101) / 100.0 >= 0.7 THEN 'conditional' ELSE 'rejected' END AS route FROM orders""")
def q_score_router(spark, sf_dir):
    """Route of each order's score, blocked where it has a critical finding."""
    d = fixture(spark, sf_dir, """SELECT o_orderkey, (o_orderkey % 101) / 100.0D AS score,
        CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS critical FROM orders""", "orders")
    return d.select("o_orderkey", alerts.score_router("score", "critical").alias("route"))


@register("pick_primary", """SELECT seq, name, "rows" FROM (SELECT min(event_id) AS seq, event_type AS name, count(*) AS "rows" FROM events GROUP BY event_type) f
ORDER BY "rows" DESC, seq LIMIT 1""")
def q_pick_primary(spark, sf_dir):
    """The largest of the datasets that the event types stand for (a top-1 report)."""
    d = fixture(spark, sf_dir, "SELECT min(event_id) AS seq, event_type AS name, count(*) AS rows FROM events GROUP BY event_type", "events")
    return files.pick_primary(d, None).select("seq", "name", "rows")


@register("local_narrative", _PHI_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY abs(phi) DESC, feature) AS k FROM a)
SELECT patient_id, string_agg('- **' || feature || '** ' || CASE WHEN abs(phi) > 0.1 THEN 'strongly' WHEN abs(phi) > 0.05 THEN 'moderately' ELSE 'slightly' END
  || CASE WHEN phi > 0 THEN ' increases' ELSE ' decreases' END || ' CVD risk (SHAP=' || CASE WHEN round(phi, 4) < 0 THEN '' ELSE '+' END || printf('%.4f', phi) || ')',
  chr(10) ORDER BY k) AS narrative FROM r WHERE k <= 5 GROUP BY patient_id""")
def q_narrative(spark, sf_dir):
    """The five largest contributions of every patient, in words."""
    return train.local_narrative(train.top_contributions(_attributions(spark, sf_dir), "patient_id"), "patient_id")


@register("noise_stability")
def q_noise(spark, sf_dir):
    """Share of closed-form verdicts that small noise on the vitals leaves as they are (rows-only)."""
    v = fixture(spark, sf_dir, fx.VITALS, "customer")
    cols = ["age", "ap_hi", "ap_lo", "cholesterol", "gluc"]

    def predict(x):
        return (0.1 + x["age"] / 100.0 + (x["ap_hi"] + x["ap_lo"] - 120.0) / 100.0 + x["cholesterol"] * 0.15 + x["gluc"] * 0.1 >= 1.8).cast("int")

    return train.noise_stability(v, cols, "patient_id", predict)


@register("quality_gate", f"""WITH d AS ({fx.ORDERS_DIRTY}), s AS (SELECT count(*) AS n FROM d)
SELECT n AS output_rows, 8 AS output_columns, 'class weights' AS imbalance_strategy, n > 0 AS quality_report_exists FROM s""")
def q_quality_gate(spark, sf_dir):
    """Shape, imbalance strategy and report existence of the prepared orders."""
    d = fixture(spark, sf_dir, fx.ORDERS_DIRTY, "orders")
    report = clean.quality_score(d).select("rows")
    return alerts.quality_gate(d, "class weights", report)


@register("binary_cast", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag FROM orders""")
def q_binary_cast(spark, sf_dir):
    """Two-valued text cast to small integers; a column that would lose values stays as it is."""
    d = fixture(spark, sf_dir, """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS flag, o_orderstatus AS status
        FROM orders""", "orders")
    cast, _ = clean.binary_cast(d, ["flag", "status"])
    return cast.select("o_orderkey", F.col("flag").cast("int").alias("flag"))


@register("coerce_age", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(20 + c_custkey % 60 AS DOUBLE) END AS age,
  'x' || c_custkey AS stage FROM customer""")
def q_coerce_age(spark, sf_dir):
    """Text age columns read as numbers, bad values null; other text stays."""
    return clean.coerce_age(fixture(spark, sf_dir, """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(20 + c_custkey % 60 AS STRING) END AS age,
        concat('x', CAST(c_custkey AS STRING)) AS stage FROM customer""", "customer"))


@register("table_sink", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_table_sink(spark, sf_dir):
    """Orders written to the Parquet sink and read back by extension."""
    views(spark, sf_dir, "orders")
    path = checkpoint_path(spark, f"sinks-{uuid.uuid4().hex}/orders.parquet")
    files.write_table(spark.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return files.read_any(spark, path)


@register("jsonl_sink", "SELECT event_id, user_id, event_type FROM events")
def q_jsonl_sink(spark, sf_dir):
    """Events appended to a JSON-lines log in two parts and scanned back."""
    views(spark, sf_dir, "events")
    path = checkpoint_path(spark, f"sinks-{uuid.uuid4().hex}/log")
    e = spark.table("events").select("event_id", "user_id", "event_type")
    files.append_jsonl(e.where("event_id % 2 = 0"), path)
    files.append_jsonl(e.where("event_id % 2 = 1"), path)
    return files.jsonl_scan(spark, path, "event_id long, user_id long, event_type string")[0]


@register("whole_text_scan", """SELECT source, string_agg(line, chr(10) ORDER BY line) || chr(10) AS text
FROM (SELECT 'block=' || (o_orderkey // 1000) AS source, 'order ' || o_orderkey AS line FROM orders) x GROUP BY source""")
def q_whole_text(spark, sf_dir):
    """All orders in one text file per thousand order keys, each read back whole.

    The key is unique, so a file has at most a thousand lines; their number grows with the table."""
    views(spark, sf_dir, "orders")
    root = checkpoint_path(spark, f"sinks-{uuid.uuid4().hex}/texts")
    lines = spark.table("orders").select(F.expr("o_orderkey div 1000").alias("block"),
                                         F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("line"))
    lines.repartition("block").sortWithinPartitions("block", "line").write.partitionBy("block").text(root)
    return files.whole_text_scan(spark, root, "*.txt", folder=True)
