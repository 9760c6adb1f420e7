"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Candidates of every kind are found in whole texts. The text between matches
gives their places: gap and match lengths add up along a text, in code
points. Each candidate value's hash is counted over the whole corpus by
distinct repositories and owners; a value of many owners is a widely copied
example, one of few owners that also looks random is a live credential.

Base kinds (assign, access, hex) are reported whatever their verdict; the
kinds that the method adds (vendor tokens, private key blocks) only where
the value is not a widely copied example.

Frequencies are pre-aggregated by value, owner and repository before the
shuffle, so a value copied into a third of the corpus stays one row a task.
Places are summed within one text's candidates only.

Null texts count as empty and hold nothing. A null owner or repository
counts as one of its own. Repeated rows and rows without an id are scanned
each for itself, very long texts are scanned whole, and an empty table gives
an empty result. Extra columns pass through ``redact``. Matches of a kind are
leftmost and do not overlap; those of two kinds may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import col, free_name, materialize

# Fixed patterns of the base kinds; letters of the first in either case. The lengths of the last two are part of the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Kinds that the method adds: tokens of well-known services and private key blocks.
VENDOR = (r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
          r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PRIVATE_KEY = r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"
# (kind, pattern, group of the value, least length of the value), in the order of the report.
KINDS = (("assign", ASSIGN, 2, ASSIGN_MIN), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0),
         ("vendor", VENDOR, 0, 0), ("pem", PRIVATE_KEY, 0, 0))
BASE_KINDS = 3

EXAMPLE_OWNERS = 3
LIVE_LENGTH = 16
LIVE_DISTINCT = 8
REPLACEMENT = "[SECRET]"


def with_candidates(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with an array ``out_col`` of one struct per kind that matches:
    kind, whole (matches), value (of each match) and gap (lengths before each match)."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    names = {}
    for n, (_, pattern, _, _) in enumerate(KINDS):
        names[n] = free_name(docs, f"_whole{n}")
        docs = docs.withColumn(names[n], F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def found(n: int) -> Column:
        _, pattern, group, _ = KINDS[n]
        whole = F.col(names[n])
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        gap = F.transform(F.split(text, pattern, -1), F.length)
        return F.when(F.size(whole) > 0, F.struct(F.lit(n).alias("kind"), whole.alias("whole"), value.alias("value"),
                                                  gap.alias("gap")))

    arrays = F.filter(F.array(*[found(n) for n in names]), lambda x: x.isNotNull())
    return docs.withColumn(out_col, arrays).drop(*names.values())


def candidate_spans(rows: DataFrame, rid: str, found: str, keep: list[str]) -> DataFrame:
    """(rid, *keep, kind, start, end, value): one row per candidate that is long
    enough; places in code points, the end exclusive."""
    kinds = rows.where(F.size(found) > 0).select(rid, *keep, F.explode(found).alias("f"))
    at = F.posexplode(F.arrays_zip(F.col("f.whole").alias("whole"), F.col("f.value").alias("value"),
                                   F.slice(F.col("f.gap"), 1, F.size("f.whole")).alias("gap"))).alias("pos", "m")
    one = kinds.select(rid, *keep, F.col("f.kind").alias("kind"), at)
    size = F.length("m.whole")
    so_far = Window.partitionBy(rid, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap").cast("long") + size).over(so_far)
    placed = one.select(rid, *keep, "kind", F.col("m.value").alias("value"), size.alias("size"), end.alias("end"))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    return placed.where(F.length("value") >= least).select(
        rid, *keep, "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def ownership(spans: DataFrame, owner: str, repo: str) -> DataFrame:
    """(digest, n_owners, n_repos): distinct owners and repositories of every candidate value's hash."""
    seen = spans.select("digest", owner, repo).distinct()
    per_owner = seen.groupBy("digest", owner).agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def looks_random(value: Column) -> Column:
    """Long and of many distinct characters, with a digit."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_LENGTH) & (distinct >= LIVE_DISTINCT) & value.rlike("[0-9]")


def judged_spans(rows: DataFrame, rid: str, found: str, owner: str, repo: str,
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(rid, kind, start, end, n_owners, n_repos, verdict): verdict is example, live or weak."""
    spans = candidate_spans(rows, rid, found, [owner, repo]).withColumn("digest", F.sha2("value", 256))
    known = spans.join(ownership(spans, owner, repo), "digest")
    verdict = (F.when(F.col("n_owners") >= example_owners, "example")
               .when(looks_random(F.col("value")), "live").otherwise("weak"))
    return known.select(rid, "kind", "start", "end", "n_owners", "n_repos", verdict.alias("verdict"))


def _of_kind(n: int):
    return lambda s: s["kind"] == n


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                  repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_live, n_example. The scanned candidates are written once."""
    plain = docs.select(col(id_col).alias("doc_id"), col(owner_col).cast("string").alias("owner"),
                        F.to_json(F.struct(*[col(c).alias(f"c{n}") for n, c in enumerate(repo_cols)])).alias("repo"),
                        col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    rows = materialize(with_candidates(plain, "text", "found").drop("text"), "candidates")
    judged = judged_spans(rows, "rid", "found", "owner", "repo", example_owners)
    # A text's own spans, in order.
    by_text = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("s"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string>>")
    every = rows.select("rid", "doc_id").join(by_text, "rid", "left").select("doc_id", F.coalesce("s", none).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < BASE_KINDS)
    shown = F.filter("s", lambda x: (x["kind"] < BASE_KINDS) | (x["verdict"] != "example"))

    def count(test) -> Column:
        return F.size(F.filter("s", test)).cast("long")

    return every.select(
        "doc_id", *[count(_of_kind(n)).alias(f"n_{KINDS[n][0]}") for n in range(BASE_KINDS)],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(shown).alias("spans"),
        count(lambda x: x["verdict"] == "live").alias("n_live"), count(lambda x: x["verdict"] == "example").alias("n_example"))


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source",
           repo_cols: tuple[str, ...] = ("source", "lang"), size_col: str | None = None,
           example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with every secret that is not a widely copied example replaced
    by ``[SECRET]``; overlapping spans become one. ``size_col``, if given, is
    set to the new length. Only texts that hold candidates are shuffled."""
    found, rid, owner, repo, cuts = (free_name(docs, n) for n in ("_found", "_rid", "_owner", "_repo", "_cuts"))
    parts = F.to_json(F.struct(*[col(c).alias(f"c{n}") for n, c in enumerate(repo_cols)]))
    marked = (docs.withColumn(owner, col(owner_col).cast("string")).withColumn(repo, parts)
              .withColumn(rid, F.monotonically_increasing_id()))
    rows = materialize(with_candidates(marked, text_col, found), "scanned")
    spans = judged_spans(rows, rid, found, owner, repo, example_owners).where(F.col("verdict") != "example")
    before = Window.partitionBy(rid).orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    merged = (spans.withColumn("fresh", fresh).withColumn("piece", F.sum("fresh").over(
        before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(rid, "piece").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    by_text = merged.groupBy(rid).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    hit = rows.where(F.size(found) > 0).join(by_text, rid, "left")
    text = col(text_col).cast("string")

    def before_cut(s: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(F.col(cuts), F.greatest(i, F.lit(1)).cast("int"))["end"])
        return F.concat(text.substr((start + 1).cast("int"), (s["start"] - start).cast("int")), F.lit(REPLACEMENT))

    tail = text.substr((F.element_at(F.col(cuts), -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(F.col(cuts).isNull(), text).otherwise(F.concat(F.array_join(F.transform(cuts, before_cut), ""), tail))
    hit = hit.withColumn(text_col, clean)
    if size_col:
        hit = hit.withColumn(size_col, F.length(col(text_col)).cast(docs.schema[size_col].dataType))
    extra = (found, rid, owner, repo)
    return rows.where(F.size(found) == 0).drop(*extra).unionByName(hit.drop(*extra, cuts))
