"""Centroid clustering: Lloyd's rounds on integer vectors by Shallot search.

A row keeps its nearest and its second-nearest centroid, an upper bound on the
distance to the nearest and a lower bound on that to all others; centroids'
moves widen the gap between them each round. Rows whose bounds meet measure both
remembered centroids and start from the closer one. Its other centroids are
scanned by rising distance from it. No centroid beyond the sum of the row's
distances to the start and to the second best so far can be among the best two,
and that ball shrinks as better ones are found. What lies inside is compared by
integer distances, equal ones by number.

A round is one pass over the stored state and one over its vectors and clusters;
the driver gets centroids * components sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, discard, table
from .integer_vectors import SLACK, as_binary, finite, from_binary, group_sums, integers, moved_means, rows_of, to_own

SCALE, DIMENSION, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: A margin for the rounding of distances between centroids.
EPSILON = 1e-9


class Layout:
    """Centroids with their distances, each one's others by rising distance, and half the distance to the closest other."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        self.centroids = centroids
        self.gaps = np.sqrt(np.stack([to_own(centroids, c) for c in centroids]).astype(np.float64))
        far = self.gaps + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.near = np.argsort(far, axis=1, kind="stable")[:, : k - 1]
        self.half = far.min(axis=1) / 2 if k > 1 else np.full(k, np.inf)


def search(x: np.ndarray, first: np.ndarray, second: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(first, second, their squared distances, distances measured) of rows x, from two remembered centroids each."""
    c, k = layout.centroids, len(layout.centroids)
    n = len(x)
    if k == 1:
        zero = np.zeros(n, np.int64)
        return zero, zero, to_own(x, c[zero]), np.full(n, np.iinfo(np.int64).max), n
    a, b = first.astype(np.int64), second.astype(np.int64)
    da, db = to_own(x, c[a]), to_own(x, c[b])
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, other, reach = a, b, np.sqrt(da.astype(np.float64))
    a, b, da, db, measured = a.copy(), b.copy(), da.copy(), db.copy(), 2 * n
    live = np.arange(n)
    for step in range(k - 1):
        j = layout.near[start[live], step]
        ball = (reach[live] + np.sqrt(db[live].astype(np.float64))) * (1 + EPSILON)
        inside = layout.gaps[start[live], j] <= ball
        live, j = live[inside], j[inside]
        if not len(live):
            break
        fresh = j != other[live]
        at, j = live[fresh], j[fresh]
        d = to_own(x[at], c[j])
        measured += len(at)
        best = (d < da[at]) | ((d == da[at]) & (j < a[at]))
        next_ = ~best & ((d < db[at]) | ((d == db[at]) & (j < b[at])))
        to = at[best]
        b[to], db[to], a[to], da[to] = a[to], da[to], j[best], d[best]
        b[at[next_]], db[at[next_]] = j[next_], d[next_]
    return a, b, da, db, measured


class Near:
    """Of n rows the two nearest centroids and the bounds."""

    def __init__(self, n: int, k: int):
        self.first, self.second = np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32)
        self.upper, self.lower = np.full(n, np.inf, np.float32), np.full(n, -np.inf, np.float32)


def reassign(x: np.ndarray, s: Near, layout: Layout, moved: np.ndarray) -> int:
    """Sets s to the nearest centroids of the rows x, the smaller number on ties; moved says how far each centroid went since. Returns the distances measured."""
    k = len(moved)
    others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])
    s.upper = (s.upper + moved[s.first] * (1 + SLACK)).astype(np.float32) * np.float32(1 + SLACK)
    lower = s.lower - others[s.first] * (1 + SLACK)
    s.lower = (lower - np.abs(np.where(np.isfinite(lower), lower, 0)) * SLACK).astype(np.float32)
    bound = np.maximum(s.lower, layout.half[s.first] * (1 - SLACK))
    doubt = np.flatnonzero(~(s.upper < bound))
    own = np.sqrt(to_own(x[doubt], layout.centroids[s.first[doubt]]).astype(np.float64)) * (1 + SLACK)
    s.upper[doubt] = own
    measured = len(doubt)
    doubt = doubt[~(own < bound[doubt])]
    a, b, da, db, more = search(x[doubt], s.first[doubt], s.second[doubt], layout)
    s.first[doubt], s.second[doubt] = a, b
    s.upper[doubt], s.lower[doubt] = np.sqrt(da.astype(np.float64)) * (1 + SLACK), np.sqrt(db.astype(np.float64)) * (1 - SLACK)
    return measured + more


def _round(layout: Layout, moved: np.ndarray, fresh: bool):
    """A pass over rows (id, v[, near, bounds])."""
    k = len(layout.centroids)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = rows_of(batch.column(1)) if n else np.zeros((0, layout.centroids.shape[1]), np.int64)
            s = Near(n, k)
            if not fresh and n:
                near, bounds = from_binary(batch.column(2), "<i4"), from_binary(batch.column(3), "<f4")
                s.first, s.second, s.upper, s.lower = near[:, 0].copy(), near[:, 1].copy(), bounds[:, 0].copy(), bounds[:, 1].copy()
            reassign(x, s, layout, moved)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], as_binary(np.stack((s.first, s.second), axis=1)), as_binary(np.stack((s.upper, s.lower), axis=1))], names=["vec_id", "v", "near", "bounds"])

    return run


def _final(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            first, d = np.zeros(0, np.int32), np.zeros(0, np.int64)
            if batch.num_rows:
                first = from_binary(batch.column(2), "<i4")[:, 0]
                d = to_own(rows_of(batch.column(1)), centroids[first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(df: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows(vec_id, cluster, distance), centroids) of the vectors of df.

    Vectors of another length than dimension, null ones and those with null,
    NaN, infinite or huge components (LIMIT / scale and more) are left out. The
    start is drawn by hashes of seed and id, rows that repeat an id by their
    components and those without id last; fewer rows give fewer centroids.
    Equal vectors share a cluster, equal centroids leave all but the first
    empty. An empty table gives no rows. Other columns are ignored.
    """
    v = F.col("v")
    source = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(F.coalesce(F.size(v) == dimension, F.lit(False)) & finite(v, scale)).select("vec_id", integers(v, scale).alias("v"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = source.select(drawn.alias("draw"), "v").orderBy(F.col("draw").asc_nulls_last(), "v").limit(centroids).collect()
    fields = StructType(source.schema.fields[:1])
    result = StructType([*fields.fields]).add("cluster", "integer").add("distance", "long")
    if not start:
        return df.sparkSession.createDataFrame([], result), np.zeros((0, dimension), np.int64)
    c = np.array([r.v for r in start], np.int64)
    moved, state = np.zeros(len(c)), None
    schema = StructType([*source.schema.fields]).add("near", "binary").add("bounds", "binary")

    def members(batch):
        first = from_binary(batch.column(1), "<i4")[:, 0].astype(np.int64)
        return rows_of(batch.column(0)), first, np.zeros(len(first), np.int64)

    for _ in range(rounds):
        last, state = state, cut((state or source).mapInArrow(_round(Layout(c), moved, state is None), schema))
        new = moved_means(c, group_sums(state.select("v", "near"), len(c), dimension, members))
        moved, c = np.sqrt(to_own(c, new).astype(np.float64)), new
        if last is not None:
            discard(last)
    rows = cut((state or source).mapInArrow(_round(Layout(c), moved, state is None), schema).mapInArrow(_final(c), result))
    if state is not None:
        discard(state)
    return rows, c


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that cluster keeps; a row per centroid is broadcast."""
    rows, c = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    about = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
