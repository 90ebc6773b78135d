"""Nearest neighbours of a query set: random-projection buckets with many probes, ranked anew by exact cosine.

Each of several tables cuts the space by random hyperplanes; a vector's bucket
is the pattern of sides it lies on. A query looks into its own bucket and those
across the planes nearest to it, cheapest first. What meets in a bucket is
compared in blocks of bounded size (a hot bucket is many blocks), each block
keeps its best k of a query, and the best k of all blocks are the answer.

With no planes there is one bucket in one table, and the answer is exact. Rows
that a metadata filter leaves out never reach the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..sources.scratch import is_small, stored

#: Vectors of a bucket on average, vectors and queries of a block, planes whose other side is probed.
BUCKET_ROWS, BLOCK_ROWS, BLOCK_QUERIES, FLIPPED = 64, 4_096, 1_024, 8
TABLES = 16
#: Queries of an audit, and the share of their neighbours that has to be found.
AUDIT_QUERIES, RECALL = 64, 0.97


def planes(dimension: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dimension))


def unit_rows(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors of length 1; those that are null, of another length, zero or not finite become zeros, like no other vector."""
    out = np.zeros((len(column), dimension))
    lists = column.to_numpy(zero_copy_only=False)
    fine = [k for k, v in enumerate(lists) if v is not None and len(v) == dimension]
    if fine:
        out[fine] = np.array([lists[k] for k in fine], np.float64)
    size = np.sqrt(np.square(out).sum(axis=1))
    bad = ~np.isfinite(size) | (size == 0)
    out[bad], size[bad] = 0, 1
    return out / size[:, None]


def probes(sides: np.ndarray, number: int) -> np.ndarray:
    """Buckets of rows of signed distances (n, bits) to planes, by rising sum of squared distances of the planes crossed."""
    n, bits = sides.shape
    own = ((sides > 0) * (1 << np.arange(bits))).sum(axis=1)
    m = min(bits, FLIPPED)
    if number <= 1 or not m:
        return own[:, None]
    near = np.argsort(np.abs(sides), axis=1)[:, :m]
    sets = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    cost = np.take_along_axis(np.square(sides), near, 1) @ sets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :number]
    return own[:, None] ^ (sets[best] * (1 << near)[:, None, :]).sum(axis=2)


def _bucketed(df: DataFrame, vector: str, dimension: int, shape: tuple[int, int, int], number: int) -> DataFrame:
    """df with buckets, an array of table * 2^bits + bucket."""
    tables, bits, seed = shape
    place, names = df.columns.index(vector), [*df.columns, "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = planes(dimension, tables, bits, seed)
        for b in batches:
            x = unit_rows(b.column(place), dimension)
            found = [probes(x @ cuts[t].T, number) + (t << bits) for t in range(tables)]
            codes = np.concatenate(found, axis=1).astype(np.int64) if len(x) else np.zeros((0, 1), np.int64)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields]).add("buckets", ArrayType(LongType())))


def _block_best(k: int, dimension: int):
    """Of a block's queries the best k of its vectors each; ties go to the smaller id."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q, v = (unit_rows(t.column(name).combine_chunks(), dimension) for t, name in ((queries, "q"), (vectors, "v")))
        qi, vi = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
        order = np.argsort(vi, kind="stable")
        v, vi = v[order], vi[order]
        sims = q @ v.T if len(q) and len(v) else np.zeros((len(q), len(v)))
        sims[qi[:, None] == vi[None]] = -np.inf
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        held = np.take_along_axis(sims, best, 1)
        keep = np.isfinite(held)
        return pa.table({"query_id": np.repeat(qi, keep.sum(axis=1)), "vec_id": vi[best[keep]], "similarity": held[keep]})

    return run


def _search(queries: DataFrame, vectors: DataFrame, k: int, dimension: int, shape: tuple[int, int, int], number: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of queries(query_id, q) and vectors(vec_id, v)."""
    asked = _bucketed(queries, "q", dimension, shape, number).select("query_id", "q", F.explode("buckets").alias("bucket"))
    held = _bucketed(vectors, "v", dimension, shape, 1).select("vec_id", "v", F.explode("buckets").alias("bucket"))
    blocks = held.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    groups = asked.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("groups"))
    sizes = stored(blocks.join(groups, "bucket"), "buckets")
    few = F.broadcast(sizes) if is_small(sizes) else sizes
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = asked.join(few, "bucket").withColumn("group", part("query_id", "groups")).withColumn("block", every("blocks")).select("bucket", "block", "group", "query_id", "q")
    right = held.join(few, "bucket").withColumn("block", part("vec_id", "blocks")).withColumn("group", every("groups")).select("bucket", "block", "group", "vec_id", "v")
    by = ["bucket", "block", "group"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_block_best(k, dimension), "query_id long, vec_id long, similarity double")
    # A pair can meet in every table, with the same similarity up to rounding.
    once = met.groupBy("query_id", "vec_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact pairs that were found; 1 where there are none."""
    pairs = exact.select("query_id", "vec_id")
    hit = pairs.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(1.0))).first()[0]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, where: Column | str | None = None, exact: bool = False, recall: float = RECALL, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, seed: int = 1) -> DataFrame:
    """(query_id, vec_id, similarity, rank, and the other columns of vectors) of the k vectors nearest to each query but itself.

    queries(query_id, q), vectors(vec_id, embedding, ...); where filters vectors
    before the search. Ids are whole numbers; equal similarities rank by id.
    Null, zero, odd or non-finite vectors have similarity 0 to all. Probes are
    doubled until AUDIT_QUERIES queries (those with the smallest hashes) find
    the share recall of their exact neighbours; where even all probes don't, and
    for tables of a few buckets, the search is exact.
    """
    held = vectors if where is None else vectors.where(where)
    v = stored(held.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")), "vectors")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
    n = v.count()
    first = v.where("size(v) > 0").select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    dimension = first.d if first else 1
    bits = max(0, int(np.log2(max(1, n / bucket_rows))))
    whole, number = (1, 0, seed), 1
    shape = whole if exact or bits < 2 else (tables, bits, seed)
    if shape != whole:
        audit = stored(q.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT_QUERIES), "audit")
        truth = stored(_search(audit, v, k, dimension, whole, 1), "truth")
        while recall_of(_search(audit, v, k, dimension, shape, number), truth) < recall:
            number *= 2
            if number > 1 << min(bits, FLIPPED):
                shape, number = whole, 1
                break
    found = _search(q, v, k, dimension, shape, number)
    rest = [c for c in held.columns if c not in ("embedding", "similarity", "rank", "query_id")]
    return found.join(held.select(*rest), "vec_id")
