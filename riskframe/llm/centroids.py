"""Centroid clustering by a bisector tournament, in exact integers.

Components are scaled and floored to integers. For every pair of centroids
``i < j`` the bisector's integer normal ``2 (c_j - c_i)`` and threshold
``|c_j|^2 - |c_i|^2`` are computed once a round; the sign of
``x . normal - threshold`` tells which of the two is nearer. A vector meets
the centroids in ascending order, the winner so far against the next one:
``k - 1`` sign tests, in which zero favours the smaller number. Only the last
winner's distance is computed.

Vectors never move. A round sends from each task, for each cluster and
component, the sum of its members, cut into 40-bit limbs so that Spark adds
them exactly whatever their size; ``k * (components + 1)`` sums reach the
driver, however many vectors there are. A lost executor costs a re-read of
its part of the table. Rounds end early when no centroid has moved, which
leaves the results as they are.

A vector is kept if it has exactly the stated number of components, none null
or non-finite; others, null vectors and empty arrays have no row. Repeated
rows are vectors of their own. A null id is hashed as the empty text; among
equal hashes the vector with the smaller components comes first. With fewer
vectors than centroids each vector starts one; an empty table gives no rows.
A distance or sum beyond the range of long is null. Extra columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import col, materialize

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3

LIMB_BITS = 40
LONG_MAX = (1 << 63) - 1


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is no double."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else math.floor(x) * scale


def int64_bound(dimensions: int) -> int:
    """Components below this bound keep every sum of a sign test and a distance within 62 bits."""
    return 1 << ((58 - math.ceil(math.log2(max(dimensions, 2)))) // 2)


class Bisectors:
    """The integer normals and thresholds of every pair of centroids."""

    def __init__(self, centroids: list[list[int]], dimensions: int):
        bound = int64_bound(dimensions)
        self.small = all(-bound < x < bound for c in centroids for x in c)
        self.centroids = centroids
        self._made: dict[type, tuple] = {}

    def arrays(self, kind: type) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
        """(centroids, normals of j against every i < j, thresholds likewise) in int64 or Python integers."""
        if kind not in self._made:
            c = np.array(self.centroids, kind)
            square = (c * c).sum(axis=1)
            self._made[kind] = (c, {j: 2 * (c[j] - c[:j]) for j in range(1, len(c))},
                                {j: square[j] - square[:j] for j in range(1, len(c))})
        return self._made[kind]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and the squared distance to it."""
        kind = np.int64 if x.dtype == np.int64 and self.small else object
        x = x.astype(kind, copy=False)
        c, normals, thresholds = self.arrays(kind)
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(c)):
            side = (x * normals[j][winner]).sum(axis=1) - thresholds[j][winner]
            winner[side > 0] = j
        away = x - c[winner]
        return winner, (away * away).sum(axis=1)


def integer_vectors(vectors: pa.Array, dimensions: int, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer components) of the kept vectors: those that fit int64 sums, then the others as Python integers."""
    size = np.asarray(vectors.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dimensions)
    if not len(rows):
        return []
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    x = flat.astype(np.float64).reshape(len(rows), dimensions)  # a null component has become NaN
    kept = np.isfinite(x).all(axis=1)
    rows, x = rows[kept], x[kept]
    bound = int64_bound(dimensions)
    small = (np.abs(x) < (bound - 1) / scale).all(axis=1)
    out = []
    if small.any():
        out.append((rows[small], np.floor(x[small] * scale).astype(np.int64)))
    if not small.all():
        large = np.array([[scaled(v, scale) for v in row] for row in x[~small].tolist()], object)
        out.append((rows[~small], large))
    return out


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """(limb number, value) with total = sum of value * 2**(40 * number); only the last value may be negative."""
    n = 0
    while total not in (0, -1):
        low = total & ((1 << LIMB_BITS) - 1)
        if low:
            yield n, low
        total >>= LIMB_BITS
        n += 1
    if total:
        yield n, total


def start_centroids(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS,
                    scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """The kept vectors with the smallest hashes of ``<seed>:<id>``; at most ``clusters`` rows reach the driver."""
    v = col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: (x > float("-inf")) & (x < float("inf")))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    first = (vectors.where((F.size(v) == dimensions) & finite).select(key.alias("h"), v.alias("v"))
             .orderBy("h", "v").limit(clusters).collect())
    return [[scaled(x, scale) for x in r["v"]] for r in first]


def moved_centroids(vectors: DataFrame, vector_col: str, centroids: list[list[int]], dimensions: int, scale: int) -> list[list[int]]:
    """The floored mean of every cluster's members; a centroid without members stays."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids, dimensions)
        sums = [[0] * (dimensions + 1) for _ in centroids]
        for batch in batches:
            for _, x in integer_vectors(batch.column(0), dimensions, scale):
                winner, _ = bisectors.assign(x)
                for c in np.unique(winner).tolist():
                    mine = x[winner == c]
                    added = [*mine.sum(axis=0).tolist(), len(mine)]
                    sums[c] = [a + int(b) for a, b in zip(sums[c], added, strict=True)]
        rows = [(c, part, n, value) for c, one in enumerate(sums) for part, total in enumerate(one) for n, value in limbs(total)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["cluster", "part", "limb", "value"])

    rows = vectors.select(col(vector_col).cast("array<double>").alias("v")).mapInArrow(
        partial, "cluster int, part int, limb int, value long")
    total = [[0] * (dimensions + 1) for _ in centroids]
    for r in rows.groupBy("cluster", "part", "limb").agg(F.sum("value").alias("value")).collect():
        total[r["cluster"]][r["part"]] += r["value"] << (LIMB_BITS * r["limb"])
    return [[s // t[-1] for s in t[:-1]] if t[-1] else old for t, old in zip(total, centroids, strict=True)]


def fit_centroids(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
                  clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """The integer centroids after the rounds."""
    centroids = start_centroids(vectors, id_col, vector_col, dimensions, clusters, scale, seed)
    for _ in range(rounds if centroids else 0):
        moved = moved_centroids(vectors, vector_col, centroids, dimensions, scale)
        if moved == centroids:
            break
        centroids = moved
    return centroids


def assign_vectors(vectors: DataFrame, centroids: list[list[int]], id_col: str = "vec_id", vector_col: str = "embedding",
                   dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every kept vector. No shuffle."""
    rows = vectors.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids, dimensions)
        for batch in batches:
            for at, x in integer_vectors(batch.column(1), dimensions, scale):
                winner, distance = bisectors.assign(x)
                far = [d if d <= LONG_MAX else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(winner.astype(np.int32)), pa.array(far, pa.int64())],
                    names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def clustered_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
                      clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    centroids = fit_centroids(vectors, id_col, vector_col, dimensions, clusters, rounds, scale, seed)
    rows = materialize(assign_vectors(vectors, centroids, id_col, vector_col, dimensions, scale), "assigned")
    lost = F.count_if(F.col("distance").isNull()) > 0
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), lost.alias("lost"))
    whole = per.agg(F.sum("sum").alias("all"), F.max("lost").alias("any_lost"))
    digests = spark.createDataFrame(
        [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids)],
        "cluster int, centroid_sha256 string")
    as_long = lambda total, gone: F.when(~F.col(gone), F.expr(f"try_cast(`{total}` AS bigint)"))
    named = (per.crossJoin(whole).join(F.broadcast(digests), "cluster")
             .select("cluster", as_long("sum", "lost").alias("cluster_inertia"), as_long("all", "any_lost").alias("inertia"),
                     "centroid_sha256"))
    return rows.join(F.broadcast(named), "cluster").select(  # a row for each centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
