import hashlib

from riskframe.operators import features, ledger
from riskframe.sources import files


def test_formats_round_trip_and_are_discovered(spark, tmp_path):
    df = spark.createDataFrame([(n, f'a "{n}", b\n' if n % 2 else None, n / 4) for n in range(25)], "k long, s string, x double").repartition(3)
    for f in ("parquet", "json"):
        files.write_any(df, f"{tmp_path}/t.{f}", rows_per_array=4)
        back = files.read_any(spark, f"{tmp_path}/t.{f}").select("k", "s", "x")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    files.write_any(df.select("k", "x"), f"{tmp_path}/t.csv")
    assert sorted(map(tuple, files.read_any(spark, f"{tmp_path}/t.csv").collect())) == sorted(map(tuple, df.select("k", "x").collect()))
    (tmp_path / "notes.md").write_text("x")
    found = {r["suffix"] for r in files.discover_files(spark, str(tmp_path)).collect()}
    assert found == {".csv", ".parquet"}


def test_sparse_places_are_those_of_the_dense_form(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, None, 7), (4, "c", 5), (5, None, None)], "id long, s string, n int").repartition(3)
    rows, levels = features.one_hot_sparse(df, "id", ["s", "n"])
    dense = features.one_hot(df, ["s", "n"])
    names = {r["index"]: f"{r['column']}_{r['value']}" for r in levels.collect()}
    assert [names[i] for i in range(len(names))] == dense.columns[1:]
    got = {r["id"]: r["indices"] for r in rows.collect()}
    for r in dense.collect():
        assert got[r["id"]] == [n for n, c in enumerate(dense.columns[1:]) if r[c]]
    wide = spark.range(12_000).selectExpr("id", "cast(id % 11000 as string) AS v")
    rows, levels = features.one_hot_sparse(wide, "id", ["v"])
    assert levels.count() == 10_999 and rows.where("size(indices) = 1").count() == 12_000 - 2


def test_handoffs_leave_out_the_last_stage(spark):
    done = spark.createDataFrame([(1, 1, "p"), (2, 2, None), (3, 3, "q")], "id long, stage long, artifact string")
    stages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "stage long, name string")
    got = sorted((r["id"], r["sender"], r["receiver"]) for r in ledger.handoff_messages(done, stages).collect())
    assert got == [(1, "a", "b"), (2, "b", "c")]


def test_checksum_of_a_file_over_two_gigabytes(spark, tmp_path):
    big, small = tmp_path / "big file.bin", tmp_path / "small.bin"
    with big.open("wb") as f:
        f.truncate((1 << 31) + 5)  # sparse: it takes no disk
        f.write(b"end")
    small.write_bytes(b"abc")
    want = {}
    for p in (big, small):
        h = hashlib.sha256()
        with p.open("rb") as f:
            while data := f.read(1 << 22):
                h.update(data)
        want[p.name] = h.hexdigest()
    assert {r["name"]: r["sha256"] for r in files.file_sha256(spark, str(tmp_path), "*.bin").collect()} == want
