"""Nearest neighbours: exact in blocks, and by buckets with measured recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import neighbours as N


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(c) for c in v], i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def brute(x, queries, k, keep=lambda i: True):
    out = {}
    unit = [np.zeros(len(x[0])) if v is None or not np.linalg.norm(v) else np.asarray(np.float32(v), float) / np.linalg.norm(np.float32(v).astype(float)) for v in x]
    for q in queries:
        s = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in range(len(x)) if i != q and keep(i))
        out[q] = [i for _, i in s[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def asked(df):
    return df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_exact_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 4)
    x = list(np.random.default_rng(0).standard_normal((200, 16)))
    x[7], x[9] = None, np.zeros(16)
    df = frame(spark, x)
    assert answers(N.nearest(asked(df), df, 5)) == brute(x, range(0, 200, 20), 5)
    some = N.nearest(asked(df), df, 4, where="label = 1")
    assert some.columns[:4] == ["vec_id", "query_id", "similarity", "rank"] and {r.label for r in some.collect()} == {1}
    assert answers(some) == brute(x, range(0, 200, 20), 4, lambda i: i % 3 == 1)
    assert N.nearest(asked(df), df.limit(0), 5).count() == 0 and N.nearest(asked(df).limit(0), df, 5).count() == 0


def test_buckets_find_neighbours(spark):
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((60, 32))
    x = list((middles[rng.integers(0, 60, 4000)] + 0.3 * rng.standard_normal((4000, 32))).astype(np.float32))
    df = frame(spark, x)
    truth = N.nearest(asked(df), df, 10, exact=True)
    for where in (None, F.col("label") < 2):
        found, exact = N.nearest(asked(df), df, 10, where=where), truth if where is None else N.nearest(asked(df), df, 10, where=where, exact=True)
        assert N.recall_of(found, exact) >= 0.95
        assert found.count() <= 2000


def test_equal_vectors_rank_by_id_and_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    x = [np.ones(8)] * 300 + list(np.random.default_rng(2).standard_normal((700, 8)))
    df = frame(spark, x)
    found = answers(N.nearest(asked(df), df, 3, tables=8, bucket_rows=50))
    assert found[0] == [1, 2, 3] and found[280] == [0, 1, 2]


def test_odd_ends_of_the_search(spark):
    x = list(np.random.default_rng(3).standard_normal((400, 8)))
    df = frame(spark, x)
    # A recall that buckets can't promise ends in the exact search.
    assert answers(N.nearest(asked(df), df, 5, tables=1, bucket_rows=10, recall=1.01)) == brute(x, range(0, 400, 20), 5)


@pytest.mark.parametrize(("bits", "number"), [(0, 4), (3, 8), (10, 32)])
def test_probes_are_distinct_and_start_at_home(bits, number):
    sides = np.random.default_rng(4).standard_normal((50, bits))
    found = N.probes(sides, number)
    home = ((sides > 0) * (1 << np.arange(bits))).sum(axis=1)
    assert (found[:, 0] == home).all()
    assert all(len(set(r)) == len(r) == min(number, 1 << bits) for r in found.tolist())
