"""FHIR bundle flattening (F-1..F-4): JSON strings -> typed structs -> one
vitals row per bundle, with explicit schemas (no inference) and
``max_by(value, position)`` for the last-observation-wins rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODING = "array<struct<system:string,code:string,display:string>>"
RESOURCE = (
    "struct<resourceType:string,id:string,gender:string,birthDate:string,status:string,"
    f"code:struct<coding:{CODING}>,subject:struct<reference:string>,"
    "valueQuantity:struct<value:double,unit:string>,valueCodeableConcept:struct<text:string>,valueInteger:int,"
    f"component:array<struct<code:struct<coding:{CODING}>,valueQuantity:struct<value:double,unit:string>>>>"
)
BUNDLE_SCHEMA = f"struct<resourceType:string,type:string,entry:array<struct<resource:{RESOURCE}>>>"

# fixed values: vitals used when a bundle carries no observation for them
DEFAULTS = {"age": 50.0, "gender": 1, "height": 168.0, "weight": 72.0, "ap_hi": 120.0, "ap_lo": 80.0,
            "cholesterol": 1, "gluc": 1, "smoke": 0, "alco": 0, "active": 1}


def fhir_flatten(bundles: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(bundle_id, pos, resource) — one row per entry; a bare Observation is one entry."""
    parsed = bundles.select(F.col(id_col).alias("bundle_id"), F.from_json(F.col(json_col), BUNDLE_SCHEMA).alias("b"),
                            F.from_json(F.col(json_col), RESOURCE).alias("single"))
    entries = F.when(F.col("b.resourceType") == "Bundle", F.transform("b.entry", lambda e: e["resource"])) \
        .when(F.col("single.resourceType") == "Observation", F.array(F.col("single")))
    return parsed.select("bundle_id", F.posexplode(entries).alias("pos", "resource"))


def _codes(coding: Column) -> Column:
    return F.transform(coding, lambda c: c["code"])


def fhir_vitals(bundles: DataFrame, id_col: str, json_col: str, as_of: str) -> DataFrame:
    """One vitals row per bundle (defaults for absent observations), with the
    patient's id and the observations' ids in order.

    Patient (the last one): birthDate -> age in years as of ``as_of`` (whole
    days / 365.25), gender male 2 / female 1. Each observation is read by the
    first rule that applies: BP panel (85354-9 / 55284-4, or any components)
    -> systolic 8480-6 / else diastolic 8462-4 components; cholesterol 2093-3
    (>= 240 -> 3, >= 200 -> 2, else 1; no value counts as 150); glucose
    2339-0 (>= 126 -> 3, >= 100 -> 2, else 1; no value counts as 90); height
    8302-2; weight 29463-7; smoking 72166-2 -> 1 when the text says
    smoker/current (a 'non-smoker' text does not count: fixed); an 'active'
    code sets active from valueInteger. Later observations win; one without
    a value keeps the value before it.
    """
    e = fhir_flatten(bundles, id_col, json_col)
    r = F.col("resource")
    codes = F.coalesce(_codes(r["code"]["coding"]), F.array().cast("array<string>"))
    is_obs = r["resourceType"] == "Observation"
    panel = (F.array_contains(codes, "85354-9") | F.array_contains(codes, "55284-4")
             | (F.coalesce(F.size(r["component"]), F.lit(0)) > 0))
    rule = F.when(is_obs, F.when(panel, "bp").when(F.array_contains(codes, "2093-3"), "chol")
                  .when(F.array_contains(codes, "2339-0"), "glu").when(F.array_contains(codes, "8302-2"), "ht")
                  .when(F.array_contains(codes, "29463-7"), "wt").when(F.array_contains(codes, "72166-2"), "smoke")
                  .when(F.lower(F.array_join(codes, ",")).contains("active"), "active"))
    comps = F.coalesce(r["component"], F.array())

    def named(c, code: str, word: str) -> Column:
        own = F.coalesce(_codes(c["code"]["coding"]), F.array().cast("array<string>"))
        return F.array_contains(own, code) | F.lower(F.array_join(own, ",")).contains(word)

    def comp_value(test) -> Column:
        hits = F.filter(comps, lambda c: test(c) & c["valueQuantity"]["value"].isNotNull())
        return F.element_at(F.transform(hits, lambda c: c["valueQuantity"]["value"]), -1)

    def systolic(c) -> Column:
        return named(c, "8480-6", "systolic")

    def diastolic(c) -> Column:
        return ~named(c, "8480-6", "systolic") & named(c, "8462-4", "diastolic")

    val = r["valueQuantity"]["value"]
    smoke_text = F.lower(F.coalesce(r["valueCodeableConcept"]["text"], F.lit("")))
    smoker = (smoke_text.contains("smoker") | smoke_text.contains("current")) & ~smoke_text.contains("non-smoker") \
        & ~smoke_text.contains("non smoker")
    x = e.withColumn("rule", rule).select(
        "bundle_id", "pos",
        F.when(r["resourceType"] == "Patient", F.struct(r["id"].alias("id"), r["birthDate"].alias("birth"),
                                                        r["gender"].alias("gender"))).alias("patient"),
        F.when(is_obs, F.coalesce(r["id"], F.lit("unknown"))).alias("obs_id"),
        F.when(F.col("rule") == "bp", comp_value(systolic)).alias("hi"),
        F.when(F.col("rule") == "bp", comp_value(diastolic)).alias("lo"),
        F.when(F.col("rule") == "chol", F.coalesce(val, F.lit(150.0))).alias("chol"),
        F.when(F.col("rule") == "glu", F.coalesce(val, F.lit(90.0))).alias("glu"),
        F.when(F.col("rule") == "ht", val).alias("ht"), F.when(F.col("rule") == "wt", val).alias("wt"),
        F.when((F.col("rule") == "smoke") & smoker, F.lit(1)).alias("sm"),
        F.when(F.col("rule") == "active", F.coalesce(r["valueInteger"], F.lit(1))).alias("act"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("pos")))
    seen = F.array_sort(F.collect_list(F.when(F.col("obs_id").isNotNull(), F.struct("pos", "obs_id"))))  # one bundle's own
    g = x.groupBy("bundle_id").agg(*[last(c).alias(c) for c in ["patient", "hi", "lo", "chol", "glu", "ht", "wt", "act"]],
                                   F.max("sm").alias("sm"), seen.alias("seen"))
    bd = F.try_to_date(F.col("patient.birth"), "yyyy-MM-dd")
    age = F.datediff(F.to_date(F.lit(as_of)), bd) / 365.25
    sex = F.when(F.col("patient.gender") == "male", 2).when(F.col("patient.gender") == "female", 1)
    d = DEFAULTS
    return g.select(
        "bundle_id",
        F.coalesce(F.round(age, 4), F.lit(d["age"])).alias("age"),
        F.coalesce(sex, F.lit(d["gender"])).alias("gender"),
        F.coalesce(F.col("ht"), F.lit(d["height"])).alias("height"),
        F.coalesce(F.col("wt"), F.lit(d["weight"])).alias("weight"),
        F.coalesce(F.col("hi"), F.lit(d["ap_hi"])).alias("ap_hi"),
        F.coalesce(F.col("lo"), F.lit(d["ap_lo"])).alias("ap_lo"),
        F.coalesce(F.when(F.col("chol") >= 240, 3).when(F.col("chol") >= 200, 2).when(F.col("chol").isNotNull(), 1),
                   F.lit(d["cholesterol"])).alias("cholesterol"),
        F.coalesce(F.when(F.col("glu") >= 126, 3).when(F.col("glu") >= 100, 2).when(F.col("glu").isNotNull(), 1),
                   F.lit(d["gluc"])).alias("gluc"),
        F.coalesce(F.col("sm"), F.lit(d["smoke"])).alias("smoke"),
        F.lit(d["alco"]).alias("alco"),
        F.coalesce(F.col("act"), F.lit(d["active"])).alias("active"),
        F.coalesce(F.col("patient.id"), F.lit("unknown")).alias("patient_ref"),
        F.transform("seen", lambda x: x["obs_id"]).alias("observations"))


def fhir_risk_assessment(scored: DataFrame, occurred: str, id_col: str = "bundle_id") -> DataFrame:
    """(id, risk_assessment): the RiskAssessment resource (JSON) of each scored
    row, with a request id derived from the bundle id and the time ``occurred``."""
    request = F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(occurred)), 256), 1, 8)
    factors = F.array_join(F.transform("top_risk_factors", lambda f: F.concat(f["factor"], F.lit(" ("), f["value"], F.lit(")"))), ", ")

    def note(prefix: str, value: Column) -> Column:
        return F.struct(F.concat(F.lit(prefix), value).alias("text"))

    level = F.col("risk_level")
    doc = F.struct(
        F.lit("RiskAssessment").alias("resourceType"), request.alias("id"), F.lit("final").alias("status"),
        F.struct(F.concat(F.lit("Patient/"), "patient_ref").alias("reference")).alias("subject"),
        F.lit(occurred).alias("occurrenceDateTime"),
        F.transform("observations", lambda o: F.struct(F.concat(F.lit("Observation/"), o).alias("reference"))).alias("basis"),
        F.array(F.struct(
            F.struct(F.lit("Cardiovascular Disease (10-year risk)").alias("text")).alias("outcome"),
            F.round("probability", 4).alias("probabilityDecimal"),
            F.struct(F.array(F.struct(
                F.lit("http://hl7.org/fhir/risk-probability").alias("system"), level.alias("code"),
                F.concat(level, F.lit(" risk of CVD")).alias("display"))).alias("coding")).alias("qualitativeRisk"),
            F.struct(F.struct(F.lit(10).alias("value"), F.lit("years").alias("unit"),
                              F.lit("http://unitsofmeasure.org").alias("system"), F.lit("a").alias("code")).alias("high"))
            .alias("whenRange"))).alias("prediction"),
        F.array(note("Top risk factors: ", factors), note("Clinical recommendation: ", F.col("recommendation")),
                note("Model explanation confidence: ", F.col("confidence"))).alias("note"))
    return scored.select(id_col, F.to_json(doc).alias("risk_assessment"))


def patient_id(id_col, raw_col) -> Column:
    """Given id, or a deterministic 8-character id from the raw document hash."""
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    raw = F.col(raw_col) if isinstance(raw_col, str) else raw_col
    return F.coalesce(i, F.substring(F.sha2(raw, 256), 1, 8))
