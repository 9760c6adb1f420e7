from pyspark.sql import functions as F

from riskframe.operators import clean, profile


def test_normalize_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["First Name", "Blood Pressure (mmHg)", "first name"])
    assert profile.normalize_columns(df).columns == ["first_name", "blood_pressure_mmhg", "first_name_2"]


def test_dedupe_removes_appended_copies(spark):
    base = spark.range(200).select((F.col("id") % 50).alias("a"), F.col("id").alias("b"))
    dup = base.unionByName(base.limit(10))
    assert clean.dedupe_exact(dup).count() == 200
    rep = clean.dedupe_report(dup).collect()[0]
    assert (rep["before"], rep["after"], rep["removed"]) == (210, 200, 10)


def test_median_and_mode_imputation(spark):
    df = spark.createDataFrame([(25.0, "M", 0), (None, None, 1), (35.0, "F", 0), (40.0, "M", 1)],
                               "age double, gender string, target int")
    out = clean.apply_impute(df, clean.impute_params(df)).orderBy("target", "age").collect()
    ages = sorted(r["age"] for r in out)
    assert ages == [25.0, 35.0, 35.0, 40.0]
    assert sorted(r["gender"] for r in out) == ["F", "M", "M", "M"]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    p = clean.impute_params(df).collect()[0]
    assert p["fill"] == "a"


def test_sparse_column_dropped(spark):
    rows = [(float(i), None) for i in range(80)] + [(float(i), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "keep double, sparse double")
    out, dropped = clean.drop_sparse(df)
    assert dropped == ["sparse"] and out.columns == ["keep"]
    # exactly 60 % null stays (strict >)
    rows = [(None,)] * 6 + [(1.0,)] * 4
    _, dropped = clean.drop_sparse(spark.createDataFrame(rows, "x double"))
    assert dropped == []


def test_outlier_is_clipped(spark):
    rows = [(float(50 + (i % 50)),) for i in range(200)] + [(9999.0,)]
    df = spark.createDataFrame(rows, "w double")
    params = clean.outlier_params(df)
    p = params.collect()[0]
    assert p["outliers"] == 1
    out = clean.winsorize(df, params)
    assert out.agg(F.max("w")).collect()[0][0] < 9999.0


def test_quality_score_range(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "x int, y string")
    q = clean.quality_score(df).collect()[0]
    assert 0 <= q["quality_score"] <= 100
    assert q["distinct_rows"] == 2


def test_profile_exact_quartiles(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 4.0, 10.0, None])], "k long, x double")
    r = profile.profile_columns(df, key_cols=["k"]).where(F.col("column") == "x").collect()[0]
    assert (r["q25"], r["q75"]) == (1.75, 5.5)
    assert r["null_count"] == 1 and r["n_unique"] == 4
    assert r["sample_numbers"] == [1.0, 2.0, 4.0, 10.0]


def test_infer_target_rules(spark):
    def target(columns, rows, **kw):
        return profile.infer_target(spark.createDataFrame(rows, columns), **kw).first()["target"]

    rows3 = [(1, 2, 3), (4, 5, 6), (7, 8, 9)]
    assert target(["feat1", "Heart_Disease", "x"], rows3) == "Heart_Disease"
    assert target(["feat1", "feat2", "label"], rows3) == "label"
    assert target(["a", "b"], [(1, 0), (2, 1), (3, 0)]) == "b"
    assert target(["a", "b"], [(1, 5), (2, 6), (3, 7)], fallback="last") == "b"
    assert target(["a", "b"], [(1, 5), (2, 6), (3, 7)]) is None
    assert target(["a", "b"], [(1, 5), (2, 6), (3, 7)], fallback="first_binary_else_last") == "b"
    assert target(["a", "label"], [(1, 5)], override="a") == "a"
