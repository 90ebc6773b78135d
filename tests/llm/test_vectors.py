"""Vector codes and centroid clusters against plain versions in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import centroid_clusters as C
from ledgerloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, v string"


def table(spark, n, seed, width=64, clumps=6):
    """Clumped vectors with repeated ones, repeated and missing ids, and all kinds of rows that stay out."""
    rnd = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    middles = [[rnd.gauss(0, 0.2) for _ in range(width)] for _ in range(clumps)]
    rows = []
    for i in range(n):
        m = rnd.choice(middles)
        rows.append((i * 3 + 1, [f32(x + rnd.gauss(0, 0.05)) for x in m], rnd.choice([None, 0, 1, 2]), "c", "e", "v"))
    rows += [(rows[0][0], rows[1][1], 5, "c", "e", "v"), rows[2], (None, rows[3][1], 1, "c", "e", "v"), (-7, rows[4][1], None, "c", "e", "v")]
    odd = [None, [], [0.5] * (width - 1), [0.5] * (width + 8), [0.1] * (width - 1) + [None], [0.1] * (width - 1) + [math.nan], [math.inf] + [0.1] * (width - 1), [1e9] * width]
    rows += [(-100 - k, v, 1, "c", "e", "v") for k, v in enumerate(odd) if not v or len(v) <= width]
    rows.append((10**9, odd[3], 1, "c", "e", "v"))
    rnd.shuffle(rows)
    return rows


def kept(rows, width, scale):
    out = []
    for r in rows:
        v = r[1]
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) < (1 << 28) / scale for x in v):
            out.append((r[0], r[2], tuple(math.floor(scale * x) for x in v)))
    return out


def nearest(x, centres):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))


def means(points, own, centres):
    out = []
    for j, c in enumerate(centres):
        held = [p for p, o in zip(points, own, strict=True) if o == j]
        out.append(tuple(sum(col) // len(held) for col in zip(*held, strict=True)) if held else c)
    return out


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096, width=64):
    rows = sorted(kept(rows, width, scale), key=lambda r: (r[0] is None, r[0], r[2]))
    w = width // parts
    books, codes, errors = [], [], []
    for p in range(parts):
        xs = [r[2][p * w : (p + 1) * w] for r in rows]
        book = xs[:entries]
        for _ in range(rounds):
            book = means(xs, [nearest(x, book)[1] for x in xs], book)
        found = [nearest(x, book) for x in xs]
        books.append(book)
        codes.append([j for _, j in found])
        errors.append([d for d, _ in found])
    error = [sum(e) for e in zip(*errors, strict=True)]
    by_label = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for entry in b for c in entry).encode()).hexdigest()
    return sorted(((r[0] is None, r[0] or 0, "".join(f"{c:02x}" for c in code), e, by_label[r[1]], digest) for r, code, e in zip(rows, zip(*codes, strict=True), error, strict=True)))


def codes_of(df):
    coded = V.compress(df)
    rows = V.with_label_error(coded.rows).withColumn("code", F.lower(F.hex("code"))).collect()
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, V.books_sha256(coded.books)) for r in rows), coded


@pytest.mark.parametrize(("n", "seed"), [(300, 1), (40, 2), (5, 3)])
def test_vector_codes(spark, n, seed):
    rows = table(spark, n, seed)
    found, _ = codes_of(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found == plain_codes(rows)


def test_vector_codes_of_equal_vectors(spark):
    rows = [(i, [0.25] * 64, None, "c", "e", "v") for i in range(50)]
    found, _ = codes_of(spark.createDataFrame(rows, SCHEMA))
    assert found == plain_codes(rows) and {r[2] for r in found} == {"00" * 8}


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "c", "e", "v")]])
def test_vector_tables_without_vectors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert V.with_label_error(V.compress(df).rows).count() == 0
    assert C.cluster(df)[0].count() == 0


def test_bounds_hold_and_net_moves_are_tighter():
    rng = np.random.default_rng(4)
    x = rng.integers(-3000, 3000, (500, 8)) // 1000 * 1000 + rng.integers(-200, 200, (500, 8))
    b, history = V.Bounds(len(x)), x[:16][None].copy()
    skipped = {"net": 0, "sum": 0}
    for _ in range(8):
        if len(history) > 1:
            up, low = V.carried(b, V.displacements(history))
            d = np.sqrt(V.to_all(x, history[-1]))
            own = d[np.arange(len(x)), b.code]
            d[np.arange(len(x)), b.code] = np.inf
            assert (up >= own - 1e-6).all() and (low <= d.min(axis=1) + 1e-6).all()
            steps = np.sqrt(np.square(np.diff(history, axis=0)).sum(axis=2))
            summed = np.vstack((np.cumsum(steps[::-1], axis=0)[::-1], np.zeros((1, 16))))
            wide, short = V.carried(b, summed)
            assert (up <= wide + 1e-6).all() and (low >= short - 1e-6).all()
            skipped["net"] += (up < low).sum()
            skipped["sum"] += (wide < short).sum()
        V.reassign(x, b, history)
        assert (b.code == V.to_all(x, history[-1]).argmin(axis=1)).all()
        new = [x[b.code == j].sum(axis=0) // (b.code == j).sum() if (b.code == j).any() else history[-1][j] for j in range(16)]
        history = np.concatenate((history, np.array(new)[None]))
    assert skipped["net"] >= skipped["sum"] > 0


def test_decoded_vectors_lie_as_far_as_their_error(spark):
    rows = table(spark, 120, 5)
    coded = V.compress(spark.createDataFrame(rows, SCHEMA))
    assert coded.scans[0] > coded.scans[-1]
    error = {r.vec_id: r.error for r in coded.rows.where("vec_id BETWEEN 10 AND 300").collect()}
    source = {r[0]: r[2] for r in kept(rows, 64, 4096)}
    found = V.decode(coded).where("vec_id BETWEEN 10 AND 300").collect()
    assert len(found) == len(error) > 90
    for r in found:
        assert sum((math.floor(4096 * a) - b) ** 2 for a, b in zip(r.vector, source[r.vec_id], strict=True)) == error[r.vec_id]


def plain_clusters(rows, k=16, rounds=3, width=64, scale=64):
    rows = kept(rows, width, scale)
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))[:k]
    centres, points = [r[2] for r in start], [r[2] for r in rows]
    for _ in range(rounds):
        centres = means(points, [nearest(x, centres)[1] for x in points], centres)
    found = [nearest(x, centres) for x in points]
    return sorted((r[0] is None, r[0] or 0, j, d) for r, (d, j) in zip(rows, found, strict=True)), centres


@pytest.mark.parametrize(("n", "seed"), [(300, 1), (40, 2), (5, 3), (0, 4)])
def test_centroid_clusters(spark, n, seed):
    rows = table(spark, n, seed) if n else [(i, [0.25] * 64, None, "c", "e", "v") for i in range(20)]
    found, centres = C.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3))
    expected, expected_centres = plain_clusters(rows)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect()) == expected
    assert centres.tolist() == [list(c) for c in expected_centres]


def test_search_finds_the_two_nearest_with_ties():
    rng = np.random.default_rng(7)
    for k in (1, 2, 3, 16, 60):
        c = rng.integers(-4, 4, (k, 3))
        x = rng.integers(-6, 6, (400, 3))
        layout = C.Layout(c)
        first = rng.integers(0, k, 400)
        second = (first + rng.integers(1, max(k, 2), 400)) % k
        a, b, da, db, measured = C.search(x, first, second, layout)
        d = np.square(x[:, None] - c[None]).sum(axis=2)
        order = np.argsort(d, axis=1, kind="stable")
        assert (a == order[:, 0]).all() and (da == d.min(axis=1)).all()
        if k > 1:
            assert (b == order[:, 1]).all() and (db == np.sort(d, axis=1)[:, 1]).all()
        if k == 60:
            assert C.search(x, a, b, layout)[4] < measured < d.size


def test_bounds_spare_distances():
    rng = np.random.default_rng(9)
    middles = rng.integers(-500, 500, (16, 8))
    x = middles[rng.integers(0, 16, 2000)] + rng.integers(-30, 30, (2000, 8))
    c, s, moved = x[:16].copy(), C.Near(len(x), 16), np.zeros(16)
    measured = []
    for _ in range(8):
        measured.append(C.reassign(x, s, C.Layout(c), moved))
        assert (s.first == np.square(x[:, None] - c[None]).sum(axis=2).argmin(axis=1)).all()
        new = np.array([x[s.first == j].sum(axis=0) // (s.first == j).sum() if (s.first == j).any() else c[j] for j in range(16)])
        moved, c = np.sqrt(np.square(c - new).sum(axis=1)), new
    assert measured[-1] < measured[0] / 4


@pytest.mark.parametrize("query", ["op11_vector_codes", "op12_centroid_clusters"])
def test_vector_queries_over_the_table(spark, sf_dir, query):
    import __spark_entry__ as entry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = entry.queries()[query](spark, sf_dir).collect()
    if query.startswith("op11"):
        assert sorted((False, r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == plain_codes(rows)
    else:
        expected, centres = plain_clusters(rows)
        assert sorted((False, r.vec_id, r.cluster, r.distance) for r in found) == expected
        sums = {}
        for _, _, j, d in expected:
            sums[j] = sums.get(j, 0) + d
        assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest() for r in found)
