"""File-level sources and sinks (S-1..S-4, S-6..S-9, S-11, S-12).

File listings come from the ``binaryFile`` source with only metadata
columns selected, so file contents are never read unless a checksum is
asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".csv", ".xlsx", ".xls", ".parquet", ".json")


def discover_files(spark: SparkSession, root: str, suffixes=SUFFIXES) -> DataFrame:
    """(path, name, suffix, size_kb, modified) for every file under ``root`` (recursive,
    case-insensitive suffix filter)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select("path", "length", "modificationTime"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return (df.withColumn("suffix", suffix).where(F.col("suffix").isin(*suffixes))
            .select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "suffix",
                    F.round(F.col("length") / 1024.0, 2).alias("size_kb"), F.col("modificationTime").alias("modified")))


STREAMED_STORES = ("file", "s3", "gs", "abfss")  # what tasks can open themselves
CHUNK_BYTES = 8 << 20


def file_sha256(spark: SparkSession, root: str, glob: str = "*", chunk: int = CHUNK_BYTES) -> DataFrame:
    """(name, sha256 hex) of the bytes of every file of a folder.

    A task opens its files and reads them ``chunk`` bytes at a time, so a file
    may have any size. In a store that only Spark's readers can open a file is
    one value, which Spark bounds at 2 GB.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    first = listed.select("path").first()
    if first is None or first["path"].split(":", 1)[0] not in STREAMED_STORES:
        return listed.select(name, F.sha2("content", 256).alias("sha256"))

    def run(batches):
        import hashlib
        from urllib.parse import unquote, urlsplit

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            digests = []
            for path in b.column(0).to_pylist():
                local = urlsplit(path).scheme == "file"
                store, place = (fs.LocalFileSystem(), unquote(urlsplit(path).path)) if local else fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with store.open_input_stream(place, compression=None, buffer_size=0) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], names=["path", "sha256"])

    # A file with much to read should not wait behind others: paths are dealt out, contents stay where they are.
    paths = listed.select("path").repartition(F.col("path"))
    return paths.mapInArrow(run, "path string, sha256 string").select(name, "sha256")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Format-dispatched read by extension (csv with header, parquet, multi-line json)."""
    p = path.lower()
    if p.endswith(".parquet"):
        return spark.read.parquet(path)
    if p.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if p.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    raise ValueError(f"unsupported file type: {path}")


def write_any(df: DataFrame, path: str, rows_per_array: int = 10_000) -> None:
    """Format-dispatched write by extension, as ``read_any`` reads: csv with header,
    parquet, or json documents that each hold an array of rows."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".json"):
        def arrays(batches):
            import pyarrow as pa
            held, size = [], 0
            for b in batches:
                for line in b.column(0).to_pylist():
                    held.append(line)
                    size += 1
                    if size >= rows_per_array:
                        yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])

        documents = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(arrays, "value string")
        documents.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)  # a file is one document
    else:
        raise ValueError(f"unsupported file type: {path}")


def pick_primary(files: DataFrame, override: str | None = None) -> DataFrame:
    """The file named ``override`` (case-insensitive) else the one with most rows; ties -> first.

    ``files`` has (seq, name, rows).
    """
    hit = F.lower(F.col("name")) == F.lit((override or "").lower())
    return files.orderBy(hit.desc(), F.col("rows").desc(), F.col("seq")).limit(1)


def inventory_of(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected artifacts (artifact) against a listing (artifact, size_bytes): exists and size (0 when missing)."""
    found = listing.groupBy("artifact").agg(F.max("size_bytes").alias("_size"))
    return (expected.join(found, "artifact", "left")
            .select("artifact", F.col("_size").isNotNull().alias("exists"),
                    F.coalesce(F.col("_size"), F.lit(0)).cast("long").alias("size_bytes")))


def artifact_inventory(spark: SparkSession, root: str, manifest: list[str]) -> DataFrame:
    """Expected file names against the files under ``root``."""
    names = spark.createDataFrame([(n,) for n in manifest], "artifact string")
    listing = discover_files(spark, root, suffixes=tuple({"." + n.rsplit(".", 1)[-1].lower() for n in manifest}))
    return inventory_of(names, listing.select(F.col("name").alias("artifact"), (F.col("size_kb") * 1024).alias("size_bytes")))


def jsonl_lines(lines: DataFrame, line_col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Tolerant JSON-lines parse of a table of lines: (rows parsed with
    ``schema``, rejected lines), each with the other columns of ``lines``.

    Blank lines are skipped; lines that are no JSON object are rejected.
    """
    others = [c for c in lines.columns if c != line_col]
    filled = lines.where(F.length(F.trim(line_col)) > 0)
    parsed = filled.select(*others, F.col(line_col).alias("raw"), F.from_json(line_col, schema, {"mode": "PERMISSIVE"}).alias("r"),
                           F.schema_of_variant(F.try_parse_json(line_col)).startswith("OBJECT").alias("_ok"))
    ok = F.coalesce("_ok", F.lit(False))
    return parsed.where(ok).select(*others, "r.*"), parsed.where(~ok).select(*others, "raw")


def jsonl_scan(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``jsonl_lines`` of the text files under ``path``."""
    return jsonl_lines(spark.read.text(path), "value", schema)


def log_validity(lines: DataFrame, line_col: str, required: list[list[str]]) -> DataFrame:
    """``lines`` with ``is_json`` and ``valid``: a JSON object that holds at least
    one key of each group in ``required``. Blank lines are left out."""
    keys = F.json_object_keys(F.when(F.try_parse_json(line_col).isNotNull(), F.col(line_col)))
    v = lines.where(F.length(F.trim(line_col)) > 0).withColumn("_k", keys)
    has = [F.arrays_overlap("_k", F.array(*[F.lit(k) for k in group])) for group in required]
    ok = F.lit(True)
    for h in has:
        ok = ok & F.coalesce(h, F.lit(False))
    return v.withColumn("is_json", F.try_parse_json(line_col).isNotNull()).withColumn("valid", F.col("is_json") & ok).drop("_k")


def json_documents(df: DataFrame, key: str) -> DataFrame:
    """(key, document): each row's other columns as one JSON document."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in df.columns if c != key])).alias("document"))


def whole_text_scan(spark: SparkSession, root: str, glob: str = "*.md", folder: bool = False) -> DataFrame:
    """One row per file: (source, text); the source is the file's name, or its folder's."""
    df = spark.read.text(root, wholetext=True, pathGlobFilter=glob)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$" if folder else r"([^/]+)$", 1)
    return df.select(name.alias("source"), F.col("value").alias("text"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
