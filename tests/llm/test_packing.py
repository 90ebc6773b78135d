"""Best-fit packing: pieces against the tokenizers library, packings against their rules, bounds and exact small optima."""

import array
import itertools
import os
import zlib

import numpy as np
import pytest

from ledgerloom.llm import packing as P

SCHEMA = "doc_id long, text string, key string, length string, source string"


@pytest.fixture(scope="module")
def spec():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, texts, library, capacity):
    """rows(doc_id, piece, start, length, ids_crc32, sequence_id, offset) hold every text once, cut and placed by the rules."""
    expected = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        bounds = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
        expected += [(doc_id, k, a, z - a, zlib.crc32(array.array("I", ids[a:z]).tobytes())) for k, (a, z) in enumerate(itertools.pairwise(bounds))]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(expected, key=order)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert not filled or max(filled.values()) <= capacity
    return len(filled), -(-sum(filled.values()) // capacity)


def test_packed_documents(spark, spec, library):
    texts = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "é" * 40 + "  zwei"), (5, "word " * 5000), (6, "x" * 9000), (7, "a b " * 511), (8, "a b " * 512)] + [(10 + i, "some words of a text " * (i % 37)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "k", "l", None) for i, t in texts], SCHEMA).repartition(3)
    packed = P.pack_documents(docs, spec, 256)
    stored = P.cut(packed)
    rows = stored.selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    n, least = check(rows, texts, library, 256)
    assert n <= least + 1
    found = {r.sequence_id: r for r in P.sequences(stored).collect()}
    for sequence_id, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        group = list(group)
        r = found[sequence_id]
        assert (r.n_pieces, r.length, bytes(r.ids)) == (len(group), sum(g.length for g in group), b"".join(bytes(g.ids) for g in group))


def test_no_documents(spark, spec):
    assert P.pack_documents(spark.createDataFrame([], SCHEMA), spec).count() == 0
    assert P.pack_documents(spark.createDataFrame([(1, None, "k", "l", "s")], SCHEMA), spec, end_id=None).count() == 0


@pytest.mark.parametrize(("low", "high", "share"), [(1, 100, 1.02), (20, 50, 1.07), (51, 100, 1.0)])
def test_many_blocks(spark, low, high, share):
    """Blocks of 150 pieces come near the bound together, also where no two pieces fit together."""
    rng = np.random.default_rng(3)
    sizes = {int(k): int(s) for k, s in zip(rng.permutation(10_000)[:900], rng.integers(low, high + 1, 900), strict=True)}
    items = P.cut(spark.createDataFrame(list(sizes.items()), "key long, length long"))
    rows = P.pack(items, 100, block_pieces=150, epochs=2).collect()
    assert sorted(r.key for r in rows) == sorted(sizes)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + sizes[r.key]
    assert max(filled.values()) <= 100
    assert len(filled) <= share * P.fewest(np.array(list(sizes.values())), 100) + 3


def exact(sizes, capacity):
    """The fewest bins, by trying all."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def test_small_packings_are_nearly_always_the_best():
    rng = np.random.default_rng(11)
    more = []
    for k in range(25):
        sizes = np.sort(rng.integers(15, 60, 11))[::-1].astype(np.int64)
        members = P.founders(sizes, k % 3, 4, 100, rng)
        for _ in range(6):
            members = P.evolve(sizes, members, 4, 20, 100, rng)
        more.append(members[0].max() + 1 - exact(sizes.tolist(), 100))
    assert max(more) <= 1 and sum(more) <= 2


def test_crossover_and_mutation_keep_every_piece():
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.integers(200, 500, 400))[::-1].astype(np.int64)
    one, other = P.founders(sizes, 1, 2, 1024, rng)
    for _ in range(20):
        child = P.crossover(sizes, one, other, 1024, rng)
        given = {tuple(np.flatnonzero(other == b)) for b in range(other.max() + 1)} & {tuple(np.flatnonzero(child == b)) for b in range(child.max() + 1)}
        assert given and child.min() == 0 and set(child) == set(range(child.max() + 1))
        for bins in (child, P.mutated(sizes, child, 1024, rng)):
            assert len(bins) == 400 and bins.min() == 0 and np.bincount(bins, sizes).max() <= 1024
    first = P.best_fit(sizes, np.full(400, -1), np.arange(400), 1024)
    pool = [first, one, other]
    for _ in range(10):
        pool = P.evolve(sizes, pool, 4, 8, 1024, rng)
    assert pool[0].max() < first.max()


def test_best_fit_takes_the_tightest_bin():
    sizes = np.array([60, 50, 45, 40, 30, 10], np.int64)
    bins = P.best_fit(sizes, np.array([0, 1, -1, -1, -1, -1]), np.array([2, 3, 4, 5]), 100)
    assert bins.tolist() == [0, 1, 1, 0, 2, 2] or np.bincount(bins, sizes).tolist() == [100, 95, 40]


def test_packing_query(spark, sf_dir, library):
    import __spark_entry__ as entry

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, least = check(entry.queries()["op13_best_fit_packing"](spark, sf_dir).collect(), texts, library, 1024)
    assert n <= 1.01 * least + 1
