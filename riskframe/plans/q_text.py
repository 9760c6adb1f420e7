"""Registered text queries: guard scans, TF-IDF retrieval, chunking, graph
lookups, advisory assembly and spec coverage (G-*, R-*, J-1, J-2, J-8, Z-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import graph, guard, text
from riskframe.plans import fixtures_sql as fx
from riskframe.plans.registry import fixture, register, views


def _docs(spark, sf_dir):
    return fixture(spark, sf_dir, fx.DOCUMENTS_PLANTED, "documents")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Fixed values, written out apart from the operator's own lists: what each scan has to find.
PII = [
    ("medicare_number", r"\b\d{4}\s?\d{5}\s?\d\b"),
    ("tfn", r"\b\d{3}\s?\d{3}\s?\d{3}\b"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"),
    ("phone_au", r"\b(\+61|0)[2-478](\s?\d{4}){2}\b"),
    ("dob", r"\b(0[1-9]|[12]\d|3[01])[-/](0[1-9]|1[012])[-/](19|20)\d\d\b"),
    ("given_name_field", r"(?i)(patient.?name|given.?name|surname|first.?name)"),
]
INJECTION = [r"(?i)ignore\s+(all\s+)?previous\s+instructions", r"(?i)system\s*prompt", r"(?i)jailbreak", r"(?i)you\s+are\s+now",
             r"(?i)DAN\s+mode", r"(?i)act\s+as\s+if", r"(?i)forget\s+your\s+training"]
OVERCLAIM = ["definitely", "absolutely certain", "100% sure", "guaranteed", "no risk", "impossible to have CVD", "will never develop"]
SCANNER = [
    (r"(?i)ignore\s+(all\s+)?previous\s+instructions", "CRITICAL"), (r"(?i)system\s*prompt\s*:", "CRITICAL"),
    (r"(?i)jailbreak", "CRITICAL"), (r"(?i)you\s+are\s+now\s+(a|an)\s+[\p{L}\p{N}_]+", "CRITICAL"), (r"(?i)DAN\s+mode", "CRITICAL"),
    (r"(?i)act\s+as\s+if\s+you", "HIGH"), (r"(?i)forget\s+(your|all)\s+training", "HIGH"), (r"(?i)roleplay\s+as", "MEDIUM"),
    (r"<script[\s>]", "HIGH"), (r"(?i)(drop|delete)\s+table", "CRITICAL"), (r"(?i)union\s+select", "CRITICAL"), (r"\.\./\.\./", "HIGH"),
    (r"(?i)eval\s*\(", "HIGH"),
]


def _list_sql(items: list[tuple[str, str]]) -> str:
    """DuckDB: list of labels whose pattern matches ``text`` (NULLs removed)."""
    parts = ", ".join(f"CASE WHEN regexp_matches(text, {_sql_str(p)}) THEN {_sql_str(n)} END" for n, p in items)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


_OVERCLAIM_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(text), {_sql_str(p.lower())}) THEN {_sql_str(p)} END" for p in OVERCLAIM
) + "], lambda x: x IS NOT NULL)"

ORACLE_PII = f"WITH d AS ({fx.DOCUMENTS_PLANTED}) SELECT doc_id, {_list_sql(PII)} AS pii FROM d"


@register("pii_scan", ORACLE_PII)
def q_pii(spark, sf_dir):
    """PII pattern types found in every document (whole texts)."""
    return _docs(spark, sf_dir).select("doc_id", F.transform(guard.pii_findings("text"), lambda x: x["type"]).alias("pii"))


ORACLE_INJECTION = (f"WITH d AS ({fx.DOCUMENTS_PLANTED}) SELECT doc_id, "
                    f"{_list_sql([(p, p) for p in INJECTION])} AS injection FROM d")


@register("injection_scan", ORACLE_INJECTION)
def q_injection(spark, sf_dir):
    """Injection patterns (all CRITICAL) matched in every document."""
    return _docs(spark, sf_dir).select(
        "doc_id", F.transform(guard.injection_findings("text"), lambda x: x["pattern"]).alias("injection"))


ORACLE_OVERCLAIM = f"WITH d AS ({fx.DOCUMENTS_PLANTED}) SELECT doc_id, {_OVERCLAIM_SQL} AS overclaim FROM d"


@register("overclaim_scan", ORACLE_OVERCLAIM)
def q_overclaim(spark, sf_dir):
    """Overclaim phrases (case-insensitive) found in every document."""
    return _docs(spark, sf_dir).select(
        "doc_id", F.transform(guard.overclaim_findings("text"), lambda x: x["trigger"]).alias("overclaim"))


def _pylist(expr: str) -> str:
    return f"'[' || array_to_string(list_transform({expr}, lambda x: '''' || x || ''''), ', ') || ']'"


ORACLE_VERDICT = f"""WITH d AS ({fx.DOCUMENTS_PLANTED}),
s AS (SELECT doc_id, {_list_sql(PII)} AS pii,
             {_list_sql([(p, p) for p in INJECTION])} AS inj, {_OVERCLAIM_SQL} AS oc FROM d),
r AS (SELECT doc_id, CASE WHEN len(pii) > 0 THEN 'PII detected: ' || {_pylist('pii')}
                          WHEN len(inj) > 0 THEN 'Potential prompt injection detected'
                          WHEN len(oc) > 0 THEN 'Clinical hallucination trigger detected: ' || {_pylist('oc')}
                          ELSE 'Clean' END AS reason FROM s)
SELECT doc_id, reason = 'Clean' AS safe, reason FROM r"""


@register("text_verdict", ORACLE_VERDICT)
def q_verdict(spark, sf_dir):
    """Combined verdict per document: PII, then injection, then overclaim, else Clean."""
    return guard.text_verdict(_docs(spark, sf_dir)).select("doc_id", "safe", "reason")


def _scanner_sql() -> str:
    inj = ", ".join(f"CASE WHEN regexp_matches(text, {_sql_str(p)}) THEN {_sql_str(s)} END"
                    for p, s in SCANNER)
    pii = ", ".join(f"CASE WHEN regexp_matches(text, {_sql_str(p)}) THEN 'HIGH' END" for _, p in PII[:3])
    return f"list_filter([{inj}, {pii}], lambda x: x IS NOT NULL)"


ORACLE_INPUT_SCAN = f"""WITH d AS ({fx.DOCUMENTS_PLANTED}), s AS (SELECT doc_id, {_scanner_sql()} AS sev FROM d)
SELECT doc_id, len(sev) AS n_findings, len(list_filter(sev, lambda x: x = 'CRITICAL')) AS critical_count,
       len(list_filter(sev, lambda x: x = 'CRITICAL')) > 0 AS blocked,
       CASE WHEN len(list_filter(sev, lambda x: x = 'CRITICAL')) > 0 THEN 'BLOCKED' WHEN len(sev) > 0 THEN 'FLAGGED'
            ELSE 'CLEAN' END AS status FROM s"""


@register("injection_scan_v2", ORACLE_INPUT_SCAN)
def q_input_scan(spark, sf_dir):
    """Input scanner with 13 severity-graded patterns + 3 PII patterns per document."""
    r = guard.input_scan(_docs(spark, sf_dir))
    return r.select("doc_id", F.size("findings").alias("n_findings"), "critical_count", "blocked", "status")


ORACLE_CORPUS = f"""WITH d AS ({fx.DOCUMENTS_PLANTED}),
s AS (SELECT source, {_list_sql(PII)} AS pii,
             {_list_sql([(p, p) for p in INJECTION])} AS inj, {_OVERCLAIM_SQL} AS oc FROM d)
SELECT source, count(*) AS documents, count(*) FILTER (WHERE len(pii) > 0) AS pii_docs,
       count(*) FILTER (WHERE len(inj) > 0) AS injection_docs, count(*) FILTER (WHERE len(oc) > 0) AS overclaim_docs,
       count(*) FILTER (WHERE len(pii) > 0 OR len(inj) > 0) AS flagged_docs,
       CASE WHEN count(*) FILTER (WHERE len(inj) > 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM s GROUP BY source"""


@register("corpus_scan", ORACLE_CORPUS)
def q_corpus(spark, sf_dir):
    """Per-source guard report over the whole document corpus."""
    return guard.corpus_scan(_docs(spark, sf_dir))


ORACLE_PII_MASK = f"WITH d AS ({fx.DOCUMENTS_PLANTED}) SELECT doc_id, " + "".join(
    "regexp_replace(" for _ in PII) + "text" + "".join(
    f", {_sql_str(p)}, '[REDACTED]', 'g')" for _, p in PII) + " AS masked FROM d"


@register("pii_mask", ORACLE_PII_MASK)
def q_pii_mask(spark, sf_dir):
    """Every PII match replaced by [REDACTED] (whole texts)."""
    return _docs(spark, sf_dir).select("doc_id", guard.pii_mask("text").alias("masked"))


def _stop_sql() -> str:
    return "(VALUES " + ", ".join(f"({_sql_str(w)})" for w in text.english_stop_words()) + ") s(term)"


ORACLE_TFIDF = f"""WITH
stop AS (SELECT term FROM {_stop_sql()}),
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term NOT IN (SELECT term FROM stop) GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
voc AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n),
w AS (SELECT doc_id, tf.term, tf * idf AS w FROM tf JOIN voc ON tf.term = voc.term),
dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w),
qt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark),
qtf AS (SELECT item_id, term, count(*) AS tf FROM qt WHERE term NOT IN (SELECT term FROM stop) GROUP BY ALL),
qw AS (SELECT item_id, qtf.term, tf * idf AS w FROM qtf JOIN voc ON qtf.term = voc.term),
qn AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS qweight FROM qw),
sim AS (SELECT item_id, doc_id, sum(weight * qweight) AS score FROM dw JOIN qn ON dw.term = qn.term GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM sim)
SELECT item_id, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 3 AND score > 0.05"""


@register("tfidf_search", ORACLE_TFIDF)
def q_tfidf(spark, sf_dir):
    """Top-3 TF-IDF cosine matches of every benchmark item over all documents."""
    views(spark, sf_dir, "documents", "benchmark")
    return text.tfidf_search(spark.table("documents"), "doc_id", "text", spark.table("benchmark"),
                             "item_id", "text", top_k=3)


@register("chunk_documents")
def q_chunks(spark, sf_dir):
    """Sentence chunks (<= 400 words, 100-word overlap) of every document (rows-only;
    tests compare it with a plain Python statement of the rule)."""
    views(spark, sf_dir, "documents")
    return text.chunk_documents(spark.table("documents"), "doc_id", "text", "source")


@register("index_stats")
def q_index_stats(spark, sf_dir):
    """Documents and chunks in the chunk index of the whole corpus (rows-only)."""
    views(spark, sf_dir, "documents")
    return text.index_stats(text.chunk_documents(spark.table("documents"), "doc_id", "text", "source"), "doc_id")


# Expected values, written out apart from the operator's own lists.
ORACLE_KEYWORD_LINK = f"""SELECT doc_id, CASE
  WHEN contains(t, 'bp') OR contains(t, 'blood pressure') OR contains(t, 'systolic') THEN 'Systolic_BP'
  WHEN contains(t, 'diastolic') THEN 'Diastolic_BP'
  WHEN contains(t, 'cholesterol') OR contains(t, 'lipid') THEN 'Cholesterol'
  WHEN contains(t, 'glucose') OR contains(t, 'sugar') THEN 'Glucose'
  WHEN contains(t, 'smoking') OR contains(t, 'smoke') THEN 'Smoking'
  WHEN contains(t, 'active') OR contains(t, 'exercise') THEN 'Active_Lifestyle'
  WHEN contains(t, 'age') THEN 'Age'
  WHEN contains(t, 'weight') OR contains(t, 'bmi') THEN 'BMI'
  WHEN contains(t, 'gender') THEN 'Gender'
  WHEN contains(t, 'pulse_pressure') THEN 'Pulse_Pressure'
  WHEN contains(t, 'alcohol') THEN 'Alcohol'
  WHEN contains(t, 'cvd_risk') THEN 'CVD_Risk'
  WHEN contains(t, 'hypertension') THEN 'Hypertension'
  WHEN contains(t, 'arterial_stiffness') THEN 'Arterial_Stiffness'
  WHEN contains(t, 'hypercholesterolemia') THEN 'Hypercholesterolemia' END AS node
FROM (SELECT doc_id, lower(text) AS t FROM ({fx.DOCUMENTS_PLANTED}) d) x"""


@register("keyword_link", ORACLE_KEYWORD_LINK)
def q_keyword_link(spark, sf_dir):
    """Graph node each document resolves to (first keyword in priority order, whole texts)."""
    return _docs(spark, sf_dir).select("doc_id", graph.keyword_node("text").alias("node"))


ORACLE_NEIGHBORS = f"""WITH l AS ({ORACLE_KEYWORD_LINK}), s AS (SELECT doc_id, node AS subject FROM l WHERE node IS NOT NULL),
n AS (SELECT * FROM (VALUES
  ('Age', 'demographic', 'Patient age in years'),
  ('Gender', 'demographic', 'Patient physiological gender'),
  ('Systolic_BP', 'vital', 'Systolic blood pressure (ap_hi)'),
  ('Diastolic_BP', 'vital', 'Diastolic blood pressure (ap_lo)'),
  ('Pulse_Pressure', 'derived_vital', 'Difference between systolic and diastolic BP'),
  ('Cholesterol', 'lab', 'Total blood cholesterol level'),
  ('Glucose', 'lab', 'Blood glucose level'),
  ('BMI', 'derived_demographic', 'Body Mass Index calculated from weight and height'),
  ('Smoking', 'lifestyle', 'Active tobacco smoking status'),
  ('Alcohol', 'lifestyle', 'Alcohol consumption status'),
  ('Active_Lifestyle', 'lifestyle', 'Level of physical activity status'),
  ('CVD_Risk', 'clinical_outcome', '10-year risk of cardiovascular disease event'),
  ('Hypertension', 'diagnosis', 'High blood pressure condition (BP >= 140/90)'),
  ('Arterial_Stiffness', 'pathology', 'Loss of arterial compliance and elasticity'),
  ('Hypercholesterolemia', 'diagnosis', 'Abnormally high levels of cholesterol in the blood')) v(id, type, description)),
e AS (SELECT * FROM (VALUES
  (0, 'Age', 'Systolic_BP', 'increases_with'), (1, 'Age', 'Arterial_Stiffness', 'causes_gradual'),
  (2, 'Smoking', 'Arterial_Stiffness', 'accelerates'), (3, 'Smoking', 'CVD_Risk', 'directly_increases'),
  (4, 'Arterial_Stiffness', 'Systolic_BP', 'increases'), (5, 'Systolic_BP', 'Pulse_Pressure', 'increases'),
  (6, 'Diastolic_BP', 'Pulse_Pressure', 'decreases'), (7, 'Systolic_BP', 'Hypertension', 'defines'),
  (8, 'Diastolic_BP', 'Hypertension', 'defines'), (9, 'Cholesterol', 'Hypercholesterolemia', 'defines'),
  (10, 'Hypercholesterolemia', 'Arterial_Stiffness', 'promotes_plaque'),
  (11, 'Glucose', 'CVD_Risk', 'induces_endothelial_damage'), (12, 'Hypertension', 'CVD_Risk', 'increases_strain'),
  (13, 'Active_Lifestyle', 'CVD_Risk', 'reduces_risk'), (14, 'Active_Lifestyle', 'Systolic_BP', 'lowers'),
  (15, 'Alcohol', 'Systolic_BP', 'increases_if_excessive')) v(epos, source, target, relationship))
SELECT doc_id, subject AS node, 'subject' AS role, type, CAST(NULL AS VARCHAR) AS relationship, description, 0 AS ord, 0 AS epos
FROM s JOIN n ON n.id = subject
UNION ALL SELECT doc_id, target, 'target', NULL, relationship, description, 1, epos
FROM s JOIN e ON s.subject = e.source JOIN n ON n.id = target
UNION ALL SELECT doc_id, source, 'source', NULL, relationship, description, 2, epos
FROM s JOIN e ON s.subject = e.target JOIN n ON n.id = source"""


@register("graph_neighbors", ORACLE_NEIGHBORS)
def q_neighbors(spark, sf_dir):
    """Subject node, successors and predecessors for each linked document."""
    nodes, edges = graph.clinical_graph(spark)
    linked = q_keyword_link(spark, sf_dir).where(F.col("node").isNotNull())
    r = graph.graph_neighbors(linked, "node", nodes, edges)
    return r.select("doc_id", "node", "role", "type", "relationship", "description", "ord", "epos")


ORACLE_GRAPH_EXPORT = """WITH e AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS source, CAST(s_nationkey AS VARCHAR) AS target FROM supplier),
n AS (SELECT DISTINCT id, type FROM (SELECT source AS id, 'supplier' AS type FROM e UNION ALL SELECT target, 'nation' FROM e) x)
SELECT 'node' AS kind, id, type, id AS description, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target,
       CAST(NULL AS VARCHAR) AS relationship FROM n
UNION ALL SELECT 'edge', NULL, NULL, NULL, source, target, 'in_nation' FROM e"""


@register("graph_export", ORACLE_GRAPH_EXPORT)
def q_graph_export(spark, sf_dir):
    """Node-link entries of the supplier -> nation graph derived from the tables."""
    views(spark, sf_dir, "supplier")
    nodes, edges = graph.graph_from_table(spark.table("supplier"), "s_suppkey", "s_nationkey", "in_nation",
                                          "supplier", "nation")
    return graph.graph_export(nodes, edges)


ORACLE_SPEC = f"""WITH s AS ({fx.SPECS}),
sc AS (SELECT sid, unnest(regexp_extract_all(spec, 'Scenario: (.+)', 1)) AS scenario FROM s),
k AS (SELECT sid, scenario, row_number() OVER (PARTITION BY sid ORDER BY scenario) AS k FROM sc),
w AS (SELECT sid, k, unnest((string_split_regex(lower(trim(scenario)), '\\s+'))[1:3]) AS w FROM k),
hit AS (SELECT DISTINCT w.sid, w.k FROM w JOIN documents d ON d.doc_id = w.sid WHERE instr(lower(d.text), w.w) > 0),
tot AS (SELECT sid, count(*) AS scenarios FROM k GROUP BY sid),
miss AS (SELECT k.sid, count(*) AS missing FROM k LEFT JOIN hit ON hit.sid = k.sid AND hit.k = k.k
         WHERE hit.sid IS NULL GROUP BY k.sid)
SELECT tot.sid, CAST(scenarios AS BIGINT) AS scenarios, CAST(coalesce(missing, 0) AS BIGINT) AS missing,
       CASE WHEN coalesce(missing, 0) = 0 THEN 'ALIGNED' ELSE 'PARTIAL' END AS status
FROM tot LEFT JOIN miss ON tot.sid = miss.sid"""


@register("spec_coverage", ORACLE_SPEC)
def q_spec(spark, sf_dir):
    """Scenario coverage of benchmark-derived specs against same-id documents."""
    specs = fixture(spark, sf_dir, fx.SPECS, "benchmark")
    views(spark, sf_dir, "documents")
    return graph.spec_coverage(specs, "sid", "spec", spark.table("documents"), "doc_id", "text").select(
        "sid", F.col("scenarios").cast("long"), F.col("missing").cast("long"), "status")
