"""Knowledge-graph tables and lookups (R-4, J-1, J-2, U-1) and the advisory
assembly (R-5, R-6) and spec coverage (J-8).

The graph is two DataFrames: nodes(id, type, description) and
edges(source, target, relationship). A text resolves to a node by one
expression; neighbours are one equi-join with a table made from the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: clinical nodes (name, type, description), in their stated order
NODES = [
    ("Age", "demographic", "Patient age in years"),
    ("Gender", "demographic", "Patient physiological gender"),
    ("Systolic_BP", "vital", "Systolic blood pressure (ap_hi)"),
    ("Diastolic_BP", "vital", "Diastolic blood pressure (ap_lo)"),
    ("Pulse_Pressure", "derived_vital", "Difference between systolic and diastolic BP"),
    ("Cholesterol", "lab", "Total blood cholesterol level"),
    ("Glucose", "lab", "Blood glucose level"),
    ("BMI", "derived_demographic", "Body Mass Index calculated from weight and height"),
    ("Smoking", "lifestyle", "Active tobacco smoking status"),
    ("Alcohol", "lifestyle", "Alcohol consumption status"),
    ("Active_Lifestyle", "lifestyle", "Level of physical activity status"),
    ("CVD_Risk", "clinical_outcome", "10-year risk of cardiovascular disease event"),
    ("Hypertension", "diagnosis", "High blood pressure condition (BP >= 140/90)"),
    ("Arterial_Stiffness", "pathology", "Loss of arterial compliance and elasticity"),
    ("Hypercholesterolemia", "diagnosis", "Abnormally high levels of cholesterol in the blood"),
]

# fixed values: directed labelled edges, in their stated order
EDGES = [
    ("Age", "Systolic_BP", "increases_with"),
    ("Age", "Arterial_Stiffness", "causes_gradual"),
    ("Smoking", "Arterial_Stiffness", "accelerates"),
    ("Smoking", "CVD_Risk", "directly_increases"),
    ("Arterial_Stiffness", "Systolic_BP", "increases"),
    ("Systolic_BP", "Pulse_Pressure", "increases"),
    ("Diastolic_BP", "Pulse_Pressure", "decreases"),
    ("Systolic_BP", "Hypertension", "defines"),
    ("Diastolic_BP", "Hypertension", "defines"),
    ("Cholesterol", "Hypercholesterolemia", "defines"),
    ("Hypercholesterolemia", "Arterial_Stiffness", "promotes_plaque"),
    ("Glucose", "CVD_Risk", "induces_endothelial_damage"),
    ("Hypertension", "CVD_Risk", "increases_strain"),
    ("Active_Lifestyle", "CVD_Risk", "reduces_risk"),
    ("Active_Lifestyle", "Systolic_BP", "lowers"),
    ("Alcohol", "Systolic_BP", "increases_if_excessive"),
]

# fixed values: keyword -> node, checked in this order (substring match)
KEYWORDS = [
    ("bp", "Systolic_BP"), ("blood pressure", "Systolic_BP"), ("systolic", "Systolic_BP"),
    ("diastolic", "Diastolic_BP"),
    ("cholesterol", "Cholesterol"), ("lipid", "Cholesterol"),
    ("glucose", "Glucose"), ("sugar", "Glucose"),
    ("smoking", "Smoking"), ("smoke", "Smoking"),
    ("active", "Active_Lifestyle"), ("exercise", "Active_Lifestyle"),
    ("age", "Age"),
    ("weight", "BMI"), ("bmi", "BMI"),
]


def clinical_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([(i, *n) for i, n in enumerate(NODES)],
                                  "pos int, id string, type string, description string")
    edges = spark.createDataFrame([(i, s, t, r) for i, (s, t, r) in enumerate(EDGES)],
                                  "pos int, source string, target string, relationship string")
    return nodes, edges


def graph_from_table(df: DataFrame, source_col: str, target_col: str, relationship: str,
                     source_type: str, target_type: str) -> tuple[DataFrame, DataFrame]:
    """Derive nodes/edges from a foreign-key table (e.g. nation -> region)."""
    edges = df.select(F.col(source_col).cast("string").alias("source"),
                      F.col(target_col).cast("string").alias("target"),
                      F.lit(relationship).alias("relationship")).distinct()
    nodes = (edges.select(F.col("source").alias("id"), F.lit(source_type).alias("type"))
             .unionByName(edges.select(F.col("target").alias("id"), F.lit(target_type).alias("type")))
             .distinct().withColumn("description", F.col("id")))
    return nodes, edges


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link entries, one row each: (kind, id, type, description, source, target, relationship)."""
    null = F.lit(None).cast("string")
    n = nodes.select(F.lit("node").alias("kind"), "id", "type", "description", null.alias("source"),
                     null.alias("target"), null.alias("relationship"))
    e = edges.select(F.lit("edge").alias("kind"), null.alias("id"), null.alias("type"), null.alias("description"),
                     "source", "target", "relationship")
    return n.unionByName(e)


def keyword_node(text: str, keywords=KEYWORDS, names: list[str] | None = None) -> Column:
    """The node a text resolves to: that of the first keyword (in list order)
    contained in the lower-cased text, else the first node whose lower-cased
    name is contained as it stands, else NULL. One expression per row."""
    names = [n[0] for n in NODES] if names is None else names
    t = F.lower(F.col(text))
    cases = [F.when(t.contains(k), F.lit(n)) for k, n in keywords] + [F.when(t.contains(n.lower()), F.lit(n)) for n in names]
    return F.coalesce(*cases)


def neighbor_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, node, role, type, relationship, description, ord, epos): per node
    itself, its successors (role 'target') and its predecessors ('source')."""
    nd = nodes.select("id", "type", "description")
    null = F.lit(None).cast("string")
    me = nd.select(F.col("id").alias("subject"), F.col("id").alias("node"), F.lit("subject").alias("role"), "type",
                   null.alias("relationship"), "description", F.lit(0).alias("ord"), F.lit(0).alias("epos"))

    def side(of: str, to: str, role: str, place: int) -> DataFrame:
        return edges.join(nd, F.col(to) == F.col("id")).select(
            F.col(of).alias("subject"), F.col(to).alias("node"), F.lit(role).alias("role"), null.alias("type"),
            "relationship", "description", F.lit(place).alias("ord"), F.col("pos").alias("epos"))

    return me.unionByName(side("source", "target", "target", 1)).unionByName(side("target", "source", "source", 2))


def graph_neighbors(subjects: DataFrame, node_col: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each subject row its node, successors and predecessors, in the order
    (``ord``, ``epos``). The subjects are read once and joined once."""
    near = neighbor_table(nodes, edges)
    return subjects.withColumnRenamed(node_col, "subject").join(near, "subject")


def spec_coverage(specs: DataFrame, spec_id: str, spec_text: str, impl: DataFrame, impl_id: str,
                  impl_text: str) -> DataFrame:
    """Scenario coverage of spec texts against implementation texts.

    Scenarios are ``Scenario: (.+)`` lines; a scenario is covered when any of
    its first three words occurs (case-insensitive) in the paired text.
    Output per spec: scenarios, missing, status ALIGNED / PARTIAL.
    """
    sc = (specs.select(F.col(spec_id).alias("sid"),
                       F.posexplode(F.regexp_extract_all(F.col(spec_text), F.lit(r"Scenario: (.+)"), 1))
                       .alias("k", "scenario")))
    words = sc.withColumn("w", F.explode(F.slice(F.split(F.lower(F.trim("scenario")), r"\s+"), 1, 3)))
    it = impl.select(F.col(impl_id).alias("sid"), F.lower(F.col(impl_text)).alias("_it"))
    hit = (words.join(it, "sid").where(F.instr("_it", F.col("w")) > 0).select("sid", "k").distinct())
    missing = sc.join(hit, ["sid", "k"], "left_anti")
    tot = sc.groupBy("sid").agg(F.count(F.lit(1)).alias("scenarios"))
    miss = missing.groupBy("sid").agg(F.count(F.lit(1)).alias("missing"))
    return (tot.join(miss, "sid", "left").fillna(0, ["missing"])
            .withColumn("status", F.when(F.col("missing") == 0, "ALIGNED").otherwise("PARTIAL"))
            .withColumnRenamed("sid", spec_id))
