"""Exact nearest neighbours by metric partitioning (M-11), the vote over them, and oversampling between them (M-2).

Points are given to the nearest of a fixed number of pivots and kept with
their distance ``r`` to it. The table is range-partitioned by (cell, r) and
cut into segments of at most 2**``SEGMENT_BITS`` rows, so a crowded cell is
many segments in many tasks. A query knows its distance ``d`` to every pivot,
and three bounds decide what it visits:

* its k-th neighbour is no farther than the k-th smallest ``d + r`` over the
  cells' closest points, and no farther than the k-th in the segment of its
  own cell around ``d``, which is searched first;
* a cell whose border (the bisector of two pivots) is farther is left out;
* by the triangle inequality a point at ``r`` is at least ``|d - r|`` away,
  which leaves out segments and, inside a segment, all but one range of rows.

Queries meet segments by an equi-join; a segment that many queries visit is
searched in several tasks, each with at most about ``QUERY_ROWS`` of them.
Only as many copies of a vector as can be among the k nearest enter the
table. The driver holds the pivots and k distances a cell.

Distances are Euclidean, in float64. Equal distances rank by the smaller key.
Rows without a key or with a null, NaN or infinite component are no
neighbours, and as queries have none. Repeated query rows are answered each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.functions.columns import dbl
from riskframe.operators.ranks import occurrence_number
from riskframe.session import written

PIVOTS = 64
SEGMENT_BITS = 13
QUERY_ROWS = 1 << 12
SLACK = 1e-9  # bounds are widened by this share, so that rounding leaves out no tie


class Neighbours(NamedTuple):
    queries: DataFrame    # query (a number for each row), and the query table's columns
    found: DataFrame      # query, rank, neighbour, distance [, payload]
    compared: DataFrame   # query, compared: how many points each query's distance was taken to


def as_vector(features: list[str] | str) -> Column:
    """One array<double> of the feature columns, or of an array column."""
    return F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[dbl(c) for c in features])


def _usable(v: str) -> Column:
    inf = float("inf")
    return F.col(v).isNotNull() & F.coalesce(F.forall(v, lambda x: (x < inf) & (x > -inf)), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def pick_pivots(points: DataFrame, n: int, seed: int) -> np.ndarray:
    """The first ``n`` different vectors by a hash of the key; a bounded number of rows reaches the driver."""
    rows = points.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), "v").select("v").limit(4 * n).collect()
    return np.array(list(dict.fromkeys(tuple(r["v"]) for r in rows))[:n], np.float64)


def partitioned_points(points: DataFrame, pivots: np.ndarray, segment_bits: int) -> DataFrame:
    """(segment, cell, r, id, v, payload) as a written table, sorted by (cell, r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d = _pivot_distances(_matrix(b.column("v")), pivots)
                cell = d.argmin(axis=1)
                r = d[np.arange(len(d)), cell]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(r), *b.columns],
                                                 names=["cell", "r", *b.schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    placed = points.mapInArrow(run, f"cell int, r double, {kinds}")
    ranged = placed.repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id")
    # Row numbers within a partition, cut into runs.
    return written(ranged.withColumn("segment", F.shiftright(F.monotonically_increasing_id(), segment_bits)), "points")


def _search(points: DataFrame, visits: DataFrame, k: int, exclude_self: bool, query_rows: int) -> DataFrame:
    """(query, id, square, payload, compared) of every visit: at most ``k`` points within the
    query's bound, and one row without a point that says how many were compared."""
    busy = visits.groupBy("segment", "cell").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("chunks"))
    asked = visits.join(busy, ["segment", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
    held = (points.join(busy, ["segment", "cell"])
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    out = f"query long, id {kind['id']}, square double, payload {kind['payload']}, compared long"

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query", "id", "square", "payload", "compared"]
        types = [pa.int64(), p.schema.field("id").type, pa.float64(), p.schema.field("payload").type, pa.int64()]
        rows: tuple[list, ...] = ([], [], [], [], [])
        if len(p) and len(q):
            p = p.sort_by([("r", "ascending"), ("id", "ascending")])
            x, r = _matrix(p["v"].combine_chunks()), p["r"].to_numpy()
            ids, payload = p["id"].to_pylist(), p["payload"].to_pylist()
            order = np.empty(len(ids), np.int64)  # of the keys, for ties
            order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            rows_of: dict = {}
            if exclude_self:
                for i, one in enumerate(ids):
                    rows_of.setdefault(one, []).append(i)
            asked_v = _matrix(q["v"].combine_chunks())
            bounds = q["bound"].to_numpy() * (1 + SLACK) + 1e-300
            slack = SLACK * (1 + q["d"].to_numpy())
            low = np.searchsorted(r, q["d"].to_numpy() - bounds - slack, "left")
            high = np.searchsorted(r, q["d"].to_numpy() + bounds + slack, "right")
            for n, (number, own) in enumerate(zip(q["query"].to_pylist(), q["own"].to_pylist(), strict=True)):
                at = np.arange(low[n], high[n])
                square = ((x[low[n]:high[n]] - asked_v[n]) ** 2).sum(axis=1)
                near = square <= bounds[n] * bounds[n]
                near[[i - low[n] for i in rows_of.get(own, ()) if low[n] <= i < high[n]]] = False
                at, square = at[near], square[near]
                if len(at) > k:
                    some = square <= np.partition(square, k - 1)[k - 1]
                    at, square = at[some], square[some]
                best = np.lexsort((order[at], square))[:k]
                rows[0].extend([number] * (len(best) + 1))
                rows[1].extend([None, *[ids[i] for i in at[best].tolist()]])
                rows[2].extend([None, *square[best].tolist()])
                rows[3].extend([None, *[payload[i] for i in at[best].tolist()]])
                rows[4].extend([int(high[n] - low[n]), *[0] * len(best)])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    by = ("segment", "cell", "chunk")
    return (held.select(*by, "r", "id", "v", "payload").groupBy(*by)
            .cogroup(asked.select(*by, "query", "own", "v", "d", "bound").groupBy(*by)).applyInArrow(run, out))


def nearest_neighbours(queries: DataFrame, points: DataFrame, key: str, features: list[str] | str, k: int,
                       exclude_self: bool = False, payload: str | None = None, pivots: int = PIVOTS, seed: int = 42,
                       segment_bits: int = SEGMENT_BITS, query_rows: int = QUERY_ROWS) -> Neighbours:
    """The ``k`` nearest points of every query row, exactly. ``exclude_self``
    leaves out points with the query's own key; ``payload`` is a column of the
    points that comes with each neighbour. Both tables name key and features alike."""
    spark = queries.sparkSession
    extra = F.col(payload) if payload else F.lit(None).cast("int")
    rows = points.select(F.col(key).alias("id"), as_vector(features).alias("v"), extra.alias("payload"))
    wanted = k + int(exclude_self)
    copies = W.partitionBy("v").orderBy("id")
    rows = rows.where(F.col("id").isNotNull() & _usable("v")).withColumn("copy", F.row_number().over(copies))
    rows = written(rows.where(F.col("copy") <= wanted).drop("copy"), "distinct_points")
    chosen = pick_pivots(rows, pivots, seed)
    asked = written(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    id_type = rows.schema["id"].dataType.simpleString()
    pay_type = rows.schema["payload"].dataType.simpleString()
    if not len(chosen):
        none = spark.createDataFrame([], f"query long, rank int, neighbour {id_type}, distance double, payload {pay_type}")
        return Neighbours(asked, none if payload else none.drop("payload"), spark.createDataFrame([], "query long, compared long"))
    table = partitioned_points(rows, chosen, segment_bits)
    segments = written(table.groupBy("segment", "cell").agg(F.min("r").alias("r_min"), F.max("r").alias("r_max")), "segments")
    closest = W.partitionBy("cell").orderBy("r")
    inner = (table.select("cell", "r").withColumn("n", F.row_number().over(closest)).where(F.col("n") <= wanted)
             .select("cell", "r").collect())  # k numbers a pivot
    inner_cell = np.array([r["cell"] for r in inner], np.int64)
    inner_r = np.array([r["r"] for r in inner], np.float64)
    between = _pivot_distances(chosen, chosen)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's own cell, its distance to the pivot and a first bound."""
        for b in batches:
            if len(b):
                d = _pivot_distances(_matrix(b.column("v")), chosen)
                home = d.argmin(axis=1)
                reach = d[:, inner_cell] + inner_r
                bound = (np.partition(reach, wanted - 1, axis=1)[:, wanted - 1] if len(inner_r) >= wanted
                         else np.full(len(d), np.inf))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home]),
                                                  pa.array(bound)], names=["query", "own", "v", "cell", "d", "bound"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells whose border a query's bound reaches, with its distance to their pivots."""
        for b in batches:
            if len(b):
                d = _pivot_distances(_matrix(b.column("v")), chosen)
                home = b.column("home").to_numpy()
                near = d[np.arange(len(d)), home]
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = (d ** 2 - near[:, None] ** 2) / (2 * between[home])
                border[np.arange(len(d)), home] = 0
                bound = b.column("bound").to_numpy()
                q, c = np.nonzero(border <= (bound * (1 + SLACK) + SLACK * (1 + near))[:, None])
                yield pa.RecordBatch.from_arrays(
                    [b.column(x).take(pa.array(q)) for x in ("query", "own", "v", "bound", "first")]
                    + [pa.array(c.astype(np.int32)), pa.array(d[q, c])], names=["query", "own", "v", "bound", "first", "cell", "d"])

    base = asked.select("query", F.col(key).alias("own"), as_vector(features).alias("v")).where(F.col("own").isNotNull() & _usable("v"))
    own_type = base.schema["own"].dataType.simpleString()
    placed = written(base.mapInArrow(place, f"query long, own {own_type}, v array<double>, cell int, d double, bound double"), "placed")
    gap = F.greatest(F.col("r_min") - F.col("d"), F.col("d") - F.col("r_max"), F.lit(0.0))
    home = (placed.join(segments, "cell").groupBy("query").agg(F.min_by("segment", F.struct(gap, "segment")).alias("segment")))
    first = written(placed.join(home, "query"), "first_visits")
    found = written(_search(table, first, k, exclude_self, query_rows), "first_found")
    kth = (found.where(F.col("id").isNotNull()).groupBy("query")
           .agg(F.when(F.count("id") >= k, F.sqrt(F.get(F.sort_array(F.collect_list("square")), F.lit(k - 1)))).alias("kth")))  # k rows a query
    closer = first.join(kth, "query", "left").select(
        "query", "own", "v", F.least("bound", "kth").alias("bound"), F.col("segment").alias("first"), F.col("cell").alias("home"))
    reached = closer.mapInArrow(cells, f"query long, own {own_type}, v array<double>, bound double, first long, cell int, d double")
    reach = F.col("bound") * (1 + SLACK) + SLACK * (1 + F.col("d"))
    visits = (reached.join(segments, "cell").where((F.col("r_max") >= F.col("d") - reach) & (F.col("r_min") <= F.col("d") + reach)))
    home_cell = first.select("query", F.col("segment"), F.col("cell"), F.lit(True).alias("done"))
    visits = visits.join(home_cell, ["query", "segment", "cell"], "left_anti")  # each (segment, cell) is searched once a query
    more = _search(table, written(visits.select("query", "own", "v", "bound", "segment", "cell", "d"), "visits"), k,
                   exclude_self, query_rows)
    every = written(found.unionByName(more), "found")
    best = W.partitionBy("query").orderBy("square", "id")
    ranked = every.where(F.col("id").isNotNull()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    columns = ["query", "rank", F.col("id").alias("neighbour"), F.sqrt("square").alias("distance")]
    return Neighbours(asked, ranked.select(*columns, *(["payload"] if payload else [])),
                      every.groupBy("query").agg(F.sum("compared").alias("compared")))


def knn_vote(train: DataFrame, test: DataFrame, key: str, features: list[str] | str, label: str, k: int = 7, **kw) -> DataFrame:
    """``test`` with ``prob``, the share of label 1 among the ``k`` nearest
    training rows, and ``pred``, the most frequent label (of equal counts the
    smallest). Training rows without a label do not vote; a test row that no
    training row can be compared with has nulls."""
    got = nearest_neighbours(test, train.where(F.col(label).isNotNull()), key, features, k, payload=label, **kw)
    votes = got.found.groupBy("query", "payload").agg(F.count(F.lit(1)).alias("n"))
    voted = votes.groupBy("query").agg(
        (F.sum(F.when(F.col("payload") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("prob"),
        F.min_by("payload", F.struct(-F.col("n"), F.col("payload"))).alias("pred"))
    return got.queries.join(voted, "query", "left").drop("query")


def _hash60(*parts: Column) -> Column:
    """A number below 2**60 from the SHA-256 of the parts, joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def oversample(train: DataFrame, label: str, key: str, features: list[str], k: int = 5, seed: int = 42,
               balanced_share: float = 0.4, **kw) -> DataFrame:
    """Minority oversampling: (label, features, base, copy, neighbour, gap), a row
    for each training row (base its key, the rest null) and enough synthetic
    rows that every class is as large as the largest.

    A synthetic row lies on the segment from its base to one of the base's
    ``k`` nearest rows of the same class, at the share ``gap``. Bases take turns
    in the order of a hash of the key; neighbour and gap come from hashes of
    key and copy number, so a run can be repeated. A class of one row is
    copied. Nothing is added if the smallest class has ``balanced_share`` of
    the labelled rows. Keys are unique; rows without a label, or whose
    features cannot be compared, stay as they are and are no bases.
    """
    kind = train.schema[key].dataType
    original = train.select(F.col(label), *[dbl(c).alias(c) for c in features], F.col(key).alias("base"),
                            F.lit(None).cast("long").alias("copy"), F.lit(None).cast(kind).alias("neighbour"),
                            F.lit(None).cast("double").alias("gap"))
    sizes = {r[label]: r["n"] for r in train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes or min(sizes.values()) >= balanced_share * sum(sizes.values()):  # sizes: a row for each class
        return original
    out, largest = original, max(sizes.values())
    for value, size in sorted(sizes.items()):
        if size == largest:
            continue
        rows = train.where(F.col(label) == F.lit(value)).select(F.col(key).alias("id"), as_vector(features).alias("v"))
        rows = written(rows.where(F.col("id").isNotNull() & _usable("v")), "minority")
        usable = rows.count()
        if not usable:
            continue
        need = largest - size
        order = F.concat_ws("|", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"), 256),
                            F.col("id").cast("string"))
        numbered = occurrence_number(rows.withColumns({"one": F.lit(1), "h": order}), ["one"], "h", "turn")
        times = F.lit(need // usable) + (F.col("turn") <= need % usable).cast("int")
        bases = numbered.withColumn("times", times).where(F.col("times") > 0).select("id", "v", "times")
        got = nearest_neighbours(bases, rows, "id", "v", k, exclude_self=True, payload="v", seed=seed, **kw)
        near = got.found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "payload"))).alias("near"))
        made = (got.queries.join(near, "query", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))))
                .withColumn("pick", F.pmod(_hash60(F.col("id"), F.col("copy"), F.lit("n"), F.lit(seed)), F.greatest(F.size("near"), F.lit(1))))
                .withColumn("to", F.get("near", F.col("pick").cast("int")))
                .withColumn("gap", _hash60(F.col("id"), F.col("copy"), F.lit("g"), F.lit(seed)) / float(1 << 60)))
        there = F.coalesce("to.payload", "v")
        value_of = [(F.col("v")[j] + F.col("gap") * (there[j] - F.col("v")[j])).alias(c) for j, c in enumerate(features)]
        out = out.unionByName(made.select(F.lit(value).cast(train.schema[label].dataType).alias(label), *value_of,
                                          F.col("id").alias("base"), "copy", F.coalesce("to.neighbour", "id").alias("neighbour"), "gap"))
    return out
