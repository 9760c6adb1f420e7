"""Text guard scans (G-1..G-5, Z-12, R-6): PII, prompt injection, overclaim
phrases, the combined verdict and per-source corpus reports.

Every scan is a column expression (Java regex via ``rlike``) evaluated on
whole texts inside whole-stage codegen; findings are ARRAY<STRUCT> columns.
Java's ``\\w`` is ASCII, so patterns that need Unicode word characters spell
the class out as ``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: PII patterns of the reference guard (name, pattern)
PII_PATTERNS = [
    ("medicare_number", r"\b\d{4}\s?\d{5}\s?\d\b"),
    ("tfn", r"\b\d{3}\s?\d{3}\s?\d{3}\b"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"),
    ("phone_au", r"\b(\+61|0)[2-478](\s?\d{4}){2}\b"),
    ("dob", r"\b(0[1-9]|[12]\d|3[01])[-/](0[1-9]|1[012])[-/](19|20)\d\d\b"),
    ("given_name_field", r"(?i)(patient.?name|given.?name|surname|first.?name)"),
]

# fixed values: injection patterns of the reference guard (all CRITICAL)
INJECTION_PATTERNS = [
    r"(?i)ignore\s+(all\s+)?previous\s+instructions",
    r"(?i)system\s*prompt",
    r"(?i)jailbreak",
    r"(?i)you\s+are\s+now",
    r"(?i)DAN\s+mode",
    r"(?i)act\s+as\s+if",
    r"(?i)forget\s+your\s+training",
]

# fixed values: overclaim phrases (case-insensitive substrings)
OVERCLAIM_PHRASES = ["definitely", "absolutely certain", "100% sure", "guaranteed",
                     "no risk", "impossible to have CVD", "will never develop"]

# fixed values: the input scanner's patterns and severities (\w spelled as a Unicode class)
SCANNER_PATTERNS = [
    (r"(?i)ignore\s+(all\s+)?previous\s+instructions", "CRITICAL"),
    (r"(?i)system\s*prompt\s*:", "CRITICAL"),
    (r"(?i)jailbreak", "CRITICAL"),
    (r"(?i)you\s+are\s+now\s+(a|an)\s+[\p{L}\p{N}_]+", "CRITICAL"),
    (r"(?i)DAN\s+mode", "CRITICAL"),
    (r"(?i)act\s+as\s+if\s+you", "HIGH"),
    (r"(?i)forget\s+(your|all)\s+training", "HIGH"),
    (r"(?i)roleplay\s+as", "MEDIUM"),
    (r"<script[\s>]", "HIGH"),
    (r"(?i)(drop|delete)\s+table", "CRITICAL"),
    (r"(?i)union\s+select", "CRITICAL"),
    (r"\.\./\.\./", "HIGH"),
    (r"(?i)eval\s*\(", "HIGH"),
]
SCANNER_PII = [("medicare", PII_PATTERNS[0][1]), ("tfn", PII_PATTERNS[1][1]), ("email", PII_PATTERNS[2][1])]


def _c(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _compact(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def pii_findings(text) -> Column:
    """ARRAY<STRUCT<type, severity, action>>: one HIGH finding per PII pattern hit."""
    t = _c(text)
    return _compact([F.when(t.rlike(p), F.struct(F.lit(n).alias("type"), F.lit("HIGH").alias("severity"),
                                                  F.lit("REDACT before logging").alias("action")))
                     for n, p in PII_PATTERNS])


def injection_findings(text) -> Column:
    """ARRAY<STRUCT<pattern, severity, action>>: every injection pattern that matches."""
    t = _c(text)
    return _compact([F.when(t.rlike(p), F.struct(F.lit(p).alias("pattern"), F.lit("CRITICAL").alias("severity"),
                                                  F.lit("BLOCK and alert Blue Team").alias("action")))
                     for p in INJECTION_PATTERNS])


def overclaim_findings(text) -> Column:
    """ARRAY<STRUCT<trigger, severity, action>>: case-insensitive phrase hits."""
    lt = F.lower(_c(text))
    return _compact([F.when(F.contains(lt, F.lit(ph.lower())),
                            F.struct(F.lit(ph).alias("trigger"), F.lit("MEDIUM").alias("severity"),
                                     F.lit("Flag for clinical review").alias("action")))
                     for ph in OVERCLAIM_PHRASES])


def _py_list(arr: Column) -> Column:
    """Render an ARRAY<STRING> like a Python list literal: ['a', 'b']."""
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'")))),
                    F.lit("]"))


def text_verdict(df: DataFrame, text: str = "text") -> DataFrame:
    """Add pii/injection/overclaim findings, ``safe`` and ``reason``.

    Precedence PII -> injection -> overclaim -> Clean. A text that cannot be
    scanned (NULL) is unsafe (fail closed).
    """
    d = (df.withColumn("pii", pii_findings(text))
         .withColumn("injection", injection_findings(text))
         .withColumn("overclaim", overclaim_findings(text)))
    reason = (F.when(F.col(text).isNull(), F.lit("Scan failed"))
              .when(F.size("pii") > 0, F.concat(F.lit("PII detected: "),
                                                _py_list(F.transform("pii", lambda x: x["type"]))))
              .when(F.size("injection") > 0, F.lit("Potential prompt injection detected"))
              .when(F.size("overclaim") > 0, F.concat(F.lit("Clinical hallucination trigger detected: "),
                                                      _py_list(F.transform("overclaim", lambda x: x["trigger"]))))
              .otherwise(F.lit("Clean")))
    return d.withColumn("reason", reason).withColumn("safe", F.col("reason") == "Clean")


def input_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Input scanner: 13 injection patterns with severities + 3 PII patterns.

    findings ARRAY<STRUCT<type, detail, severity>>, critical_count, blocked,
    status BLOCKED (any CRITICAL) / FLAGGED (any finding) / CLEAN.
    """
    t = _c(text)
    inj = [F.when(t.rlike(p), F.struct(F.lit("PROMPT_INJECTION").alias("type"), F.lit(p).alias("detail"),
                                       F.lit(s).alias("severity"))) for p, s in SCANNER_PATTERNS]
    pii = [F.when(t.rlike(p), F.struct(F.lit("PII_DETECTED").alias("type"), F.lit(n).alias("detail"),
                                       F.lit("HIGH").alias("severity"))) for n, p in SCANNER_PII]
    d = df.withColumn("findings", _compact(inj + pii))
    crit = F.size(F.filter("findings", lambda f: f["severity"] == "CRITICAL"))
    return (d.withColumn("critical_count", crit)
            .withColumn("blocked", F.col("critical_count") > 0)
            .withColumn("status", F.when(F.col("blocked"), "BLOCKED")
                        .when(F.size("findings") > 0, "FLAGGED").otherwise("CLEAN")))


def corpus_scan(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Per-source report: documents, PII / injection / overclaim hits, status.

    A document is CLEAN unless it has PII or injection findings; a source
    PASSes iff none of its documents has a CRITICAL (injection) finding — PII
    alone does not fail it.
    """
    v = text_verdict(df, text)
    return (v.groupBy(source).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.size("pii") > 0).alias("pii_docs"),
        F.count_if(F.size("injection") > 0).alias("injection_docs"),
        F.count_if(F.size("overclaim") > 0).alias("overclaim_docs"),
        F.count_if((F.size("pii") > 0) | (F.size("injection") > 0)).alias("flagged_docs"))
        .withColumn("status", F.when(F.col("injection_docs") > 0, "FAIL").otherwise("PASS")))


def pii_mask(text, token: str = "[REDACTED]") -> Column:
    """Replace every PII pattern match by ``token`` (redaction the guard recommends)."""
    t = _c(text)
    for _, p in PII_PATTERNS:
        t = F.regexp_replace(t, p, token)
    return t
