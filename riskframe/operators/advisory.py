"""Advisory report (R-5) and guarded answer (R-6): one text per query row, put
together from retrieved chunks, graph neighbours and optional vitals.

Everything is one expression over columns that the caller has joined to the
query: no collect, no per-row Python. The compile time is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators import guard

# The report's lines.
TITLE = "### 🏥 CLINICAL ADVISORY REPORT"
VITALS_HEAD = "#### 📋 Patient Vitals Provided:"
EVIDENCE_HEAD = "#### 📖 Retrieved Guideline Evidence:"
GRAPH_HEAD = "\n#### 🔬 Clinical Graph Relationships:"
GRAPH_INTRO = "We identified the following anatomical/physiological relationships for your query:"
GRAPH_NONE = "- No specific graph relations found. Normal physiological pathways apply."
ADVICE_HEAD = "\n#### 💡 Evidence-based Recommendations:"
NHFA = "> **From National Heart Foundation of Australia (NHFA) Guidelines:**"
EVIDENCE_BP = [NHFA, "> Normal blood pressure is <120/80 mmHg. Grade 2 Hypertension is defined as BP >=140/90 mmHg. "
               "Immediate pharmacological therapy is recommended for all patients with BP >=140/90 mmHg or those with "
               "Grade 1 Hypertension and high absolute cardiovascular disease risk."]
EVIDENCE_LIPID = [NHFA, "> Desirable total cholesterol is <5.0 mmol/L. For patients identified as high absolute risk, "
                  "lipid-lowering pharmacotherapy (Statins) should be initiated to target an LDL-C reduction of >=50% or "
                  "target LDL-C <1.8 mmol/L."]
EVIDENCE_OTHER = ["> Guideline: Implement lifestyle modifications including sodium restriction (<2g/day), regular "
                  "cardiovascular exercise (30 mins/day), and smoking cessation programs for general CVD risk mitigation."]
ADVICE_BP = ["1. **Diagnostic Validation:** Confirm blood pressure measurements across multiple visits unless severe "
             "(>=180/110 mmHg).",
             "2. **Therapeutic Action:** Introduce lifestyle changes (reduced sodium, cardiovascular exercise) and "
             "first-line anti-hypertensive drugs (ACEi/ARB) for high-risk patients."]
ADVICE_LIPID = ["1. **Therapeutic Action:** Recommend high-intensity statin therapy (Atorvastatin 40-80mg or Rosuvastatin "
                "20-40mg) for patients in high absolute risk category.",
                "2. **Follow-up:** Re-check lipid profiles in 4-6 weeks to verify therapeutic compliance."]
ADVICE_OTHER = ["1. **Absolute Risk Profiling:** Perform absolute CVD risk evaluation using demographic and physiological "
                "markers.",
                "2. **Lifestyle Modification:** Advocate sodium reduction, healthy diet, and regular activity."]
CLOSING = ["\n> [!NOTE]", "> This advice is synthesized from Australian Clinical Guidelines (NHFA) for cardiovascular "
           "management. Clinical judgement must override automated summaries."]
BLOCKED = "[BLOCKED BY CLINICAL GUARDRAIL] The generated advice failed safety checks. Reason: "
SOURCES = [("National Heart Foundation of Australia (NHFA) Guidelines for Hypertension Management", 0.92),
           ("NHFA Guidelines for Lipid and Cholesterol Management", 0.85)]


def _lines(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _topic(query: Column, bp: list[str], lipid: list[str], other: list[str]) -> Column:
    q = F.lower(query)
    return (F.when(q.contains("bp") | q.contains("blood pressure") | q.contains("hypertension"), _lines(bp))
            .when(q.contains("cholesterol") | q.contains("lipid"), _lines(lipid)).otherwise(_lines(other)))


def advisory_report(query: str, chunks: str, nodes: str, compiled_on: str, vitals: str | None = None) -> Column:
    """The report text of a row.

    ``chunks`` is an array of (source, text, score), best first; ``nodes`` an
    array of (node, role, type, relationship, description) in order; empty
    or null arrays give the fallback lines. ``vitals`` names a struct of
    vitals, left out where null.
    """
    q = F.col(query)
    head = F.array(F.lit(TITLE), _text("*Compiled on: ", F.lit(compiled_on), "*"), _text('*Clinician Query: "', q, '"*\n'))
    none = F.array().cast("array<string>")
    patient = none
    if vitals:
        v = F.col(vitals)
        patient = F.when(v.isNull(), none).otherwise(F.array(
            F.lit(VITALS_HEAD), _text("- **Age**: ", v["age"], " years"),
            _text("- **Gender**: ", F.when(v["gender"] == 2, "Male").otherwise("Female")),
            _text("- **Blood Pressure**: ", v["ap_hi"], "/", v["ap_lo"], " mmHg"),
            _text("- **Total Cholesterol**: Level ", v["cholesterol"], " (Normal: 1, Elevated: 2, High: 3)"),
            _text("- **Smoker**: ", F.when(v["smoke"] == 1, "Yes").otherwise("No")),
            _text("- **Physical Activity**: ", F.when(v["active"] == 1, "Active").otherwise("Sedentary"), "\n")))
    found = F.flatten(F.transform(chunks, lambda c: F.array(
        _text("> **Section from ", c["source"], ":**"), _text("> ", c["text"]),
        _text("> *(Relevance score: ", c["score"], ")*\n"))))
    evidence = F.when(F.size(chunks) > 0, found).otherwise(_topic(q, EVIDENCE_BP, EVIDENCE_LIPID, EVIDENCE_OTHER))

    def relation(n) -> Column:
        tail = F.concat(F.lit("Relationship type: *"), n["relationship"], F.lit("*). Description: *"), n["description"], F.lit("*"))
        return F.when(n["role"] == "target", F.concat(F.lit("- Relationship: `"), n["node"],
                                                      F.lit("` is impacted by query topic ("), tail)).otherwise(
            F.concat(F.lit("- Relationship: Query topic is impacted by `"), n["node"], F.lit("` ("), tail))

    subject = F.transform(F.filter(nodes, lambda n: n["role"] == "subject"), lambda n: _text(
        "\n*Query topic definition:* **", n["node"], "** (", n["type"], "): ", n["description"], "\n"))
    relations = F.transform(F.filter(nodes, lambda n: n["role"] != "subject"), relation)
    graph = F.when(F.size(nodes) > 0, F.concat(_lines([GRAPH_INTRO]), relations, F.slice(subject, 1, 1))).otherwise(_lines([GRAPH_NONE]))
    return F.array_join(F.concat(
        head, patient, _lines([EVIDENCE_HEAD]), evidence, _lines([GRAPH_HEAD]), graph, _lines([ADVICE_HEAD]),
        _topic(q, ADVICE_BP, ADVICE_LIPID, ADVICE_OTHER), _lines(CLOSING)), "\n")


def guarded_answer(reports: DataFrame, report: str = "report") -> DataFrame:
    """``reports`` with ``answer``, ``sources`` and ``safe``: a report that fails the
    guard's verdict is replaced by the reason, without sources."""
    text = reports.withColumnRenamed(report, "text")
    v = guard.text_verdict(text)
    sources = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(r).alias("relevance")) for t, r in SOURCES])
    return (v.withColumn("answer", F.when(F.col("safe"), F.col("text")).otherwise(F.concat(F.lit(BLOCKED), F.col("reason"))))
            .withColumn("sources", F.when(F.col("safe"), sources).otherwise(F.slice(sources, 1, 0)))
            .withColumnRenamed("text", report))
