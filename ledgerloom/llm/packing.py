"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are encoded where they lie and cut into pieces; a piece that fills a
sequence is one. The others are sorted by length and dealt like cards to blocks
of about BLOCK_PIECES, so that all blocks have the same mixture of lengths, and
each block's packing is evolved on several islands. A member
of an island is a packing of the whole block, a gene is a bin with all its
pieces. A child takes whole well-filled bins from one parent; bins of the other
parent that hold a piece of these are dissolved, so that no piece is there
twice, and their other pieces are placed again by best fit, long ones first.
Mutation dissolves the emptiest bins and some others. After every epoch each
island's best member migrates to the next island of its block, by a join. A block
whose packing has as few bins as its lengths allow is not evolved any further.

The best packing of each block is kept. Its badly filled bins (all blocks but
the last few have one) are dissolved, and their pieces go through the same once
more in fewer blocks, until they are one block. Only keys and lengths take part;
ids stay in the table of pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import text_groups
from .common import cut, discard, scratch, table
from .token_files import END_ID, _pieces

CAPACITY = 1_024
#: Text that is encoded at a time, more than in token_files: no writer of large row groups needs memory beside it.
GROUP_BYTES = 16 << 20
BLOCK_PIECES = 4_096
ISLANDS, MEMBERS, EPOCHS, CHILDREN = 3, 4, 3, 8
#: Bins filled to this share are left alone when blocks are joined.
WELL_FILLED = 0.95


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """(key, doc_id, piece, start, length, ids): token ids of each document with an end id, in pieces of at most capacity.

    ids are little-endian unsigned 32-bit integers. Only longer documents are
    cut, into pieces of capacity ids after a first one with the rest. Null and
    empty texts are their end id alone (no piece where there is none). Repeated
    rows and rows without doc_id have pieces of their own; other columns are
    ignored. The key tells pieces apart once the table is stored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches):
        encoder = _pieces(shared)
        for b in batches:
            texts = b.column(1)
            for lo, hi in text_groups(texts, GROUP_BYTES):
                found = encoder.lists(texts.slice(lo, hi - lo), end)
                at = found.offsets.to_numpy().astype(np.int64)
                size = np.diff(at)
                count = -(-size // capacity)
                row, piece = np.repeat(np.arange(hi - lo), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                # The first piece is as much shorter as the pieces could hold more.
                start = np.maximum(piece * capacity - (count * capacity - size)[row], 0)
                bounds = np.append(at[row] + start, at[-1])
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(found.values.to_numpy())])
                columns = [b.column(0).take(pa.array(lo + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(np.diff(bounds)), ids]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")
    return found.select(F.monotonically_increasing_id().alias("key"), *names)


class Room:
    """Open bins by the room they have left."""

    def __init__(self, room: np.ndarray):
        self.bins: dict[int, list[int]] = {}
        self.mask = 0
        for b in np.flatnonzero(room > 0).tolist():
            self.put(b, int(room[b]))

    def put(self, b: int, room: int) -> None:
        self.bins.setdefault(room, []).append(b)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int]:
        """A bin with the least room that size fits into and that room; (-1, 0) where there is none."""
        fits = self.mask >> size
        if not fits:
            return -1, 0
        room = size + (fits & -fits).bit_length() - 1
        held = self.bins[room]
        b = held.pop()
        if not held:
            self.mask ^= 1 << room
        return b, room


def best_fit(sizes: np.ndarray, bins: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """bins (a bin's number for each piece, -1 for none) with the pieces of order placed one after another."""
    fill = np.bincount(bins[bins >= 0], sizes[bins >= 0]).astype(np.int64)
    room, n, out = Room(capacity - fill), len(fill), bins.copy()
    placed = []
    for size in sizes[order].tolist():
        b, left = room.take(size)
        if b < 0:
            b, left, n = n, capacity, n + 1
        if left > size:
            room.put(b, left - size)
        placed.append(b)
    out[order] = placed
    return out


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Fewer bins are better, then unequally filled ones."""
    fill = np.bincount(bins, sizes)
    return float(np.square(fill / capacity).mean() - len(fill))


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """A bound on the number of bins: by the sum of lengths, and by pieces of which no two fit together."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()), 1)


def _renumbered(bins: np.ndarray) -> np.ndarray:
    out = bins.copy()
    held = bins >= 0
    out[held] = np.unique(bins[held], return_inverse=True)[1]
    return out


def _falling(sizes: np.ndarray, at: np.ndarray, rng: np.random.Generator, noise: float) -> np.ndarray:
    """at by falling size, a little out of order."""
    return at[np.argsort(-sizes[at] * (1 + noise * rng.random(len(at))), kind="stable")]


def crossover(sizes: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of one with whole well-filled bins of other."""
    fill = np.bincount(other, sizes)
    best = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    given = np.zeros(len(fill), bool)
    given[best[rng.random(len(best)) < rng.uniform(0.2, 0.8)]] = True
    injected = given[other]
    child = one.copy()
    hit = np.zeros(one.max() + 1, bool)
    hit[one[injected]] = True
    displaced = hit[one] & ~injected
    child[injected] = other[injected] + len(hit)
    child[displaced] = -1
    return best_fit(sizes, _renumbered(child), _falling(sizes, np.flatnonzero(displaced), rng, 0.05), capacity)


def mutated(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """bins with the emptiest ones and a few others dissolved and packed again."""
    fill = np.bincount(bins, sizes)
    gone = np.argsort(fill, kind="stable")[: 1 + len(fill) // 50]
    gone = np.union1d(gone, rng.integers(0, len(fill), 1 + len(fill) // 20))
    displaced = np.isin(bins, gone)
    out = np.where(displaced, -1, bins)
    return best_fit(sizes, _renumbered(out), _falling(sizes, np.flatnonzero(displaced), rng, 0.2), capacity)


def founders(sizes: np.ndarray, island: int, members: int, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Packings by best fit in falling order, on all islands but the first somewhat out of order; only the first packing where it can't be bettered."""
    none, every = np.full(len(sizes), -1, np.int32), np.arange(len(sizes))
    out = []
    for m in range(members):
        out.append(best_fit(sizes, none, _falling(sizes, every, rng, 0.0 if island == m == 0 else 0.1 * (m + 1)), capacity))
        if out[-1].max() + 1 == fewest(sizes, capacity):
            break
    return out


def evolve(sizes: np.ndarray, members: list[np.ndarray], size: int, children: int, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The best size members, best first, after so many children: the better of two random members with another one."""
    pool: dict[float, np.ndarray] = {}

    def admit(member: np.ndarray) -> None:
        """Of equally fit members one is enough: others would crowd out what differs."""
        pool.setdefault(fitness(sizes, member, capacity), member)

    for m in members:
        admit(m)
    least = fewest(sizes, capacity)
    for _ in range(children):
        ranked = sorted(pool, reverse=True)[:size]
        if pool[ranked[0]].max() + 1 <= least:
            break
        one, other = (pool[ranked[k]] for k in (min(rng.integers(0, len(ranked), 2)), rng.integers(len(ranked))))
        child = crossover(sizes, one, other, capacity, rng) if one is not other else one
        admit(child)
        admit(mutated(sizes, child, capacity, rng))
    return [pool[f] for f in sorted(pool, reverse=True)[:size]]


STATE = "block long, island int, sizes binary, members binary, best binary, fitness double"


def _island(members: int, children: int, capacity: int, epoch: int):
    """A task's islands: founded where there is no member yet, evolved with the immigrant otherwise."""

    def run(batches):
        for b in batches:
            out = []
            for block, island, sizes, old, guest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rng = np.random.default_rng([epoch, block, island])
                s = np.frombuffer(sizes, "<i4").astype(np.int64)
                if old is None:
                    pool = founders(s, island, members, capacity, rng)
                else:
                    pool = [*np.frombuffer(old, "<i4").reshape(-1, len(s))] + ([np.frombuffer(guest, "<i4")] if guest else [])
                pool = evolve(s, pool, members, children, capacity, rng)
                out.append((block, island, sizes, np.stack(pool).astype("<i4").tobytes(), pool[0].astype("<i4").tobytes(), fitness(s, pool[0], capacity)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["block", "island", "sizes", "members", "best", "fitness"])

    return run


def _places(capacity: int):
    """Rows of (keys, sizes, bins) as (key, length, sequence_id, offset, filled); a bin is named by its smallest key."""

    def run(batches):
        for b in batches:
            for keys, sizes, bins in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, size, own = np.array(keys, np.int64), np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(bins, "<i4")
                order = np.lexsort((key, own))
                key, size, own = key[order], size[order], own[order]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                count = np.diff(np.r_[first, len(own)])
                before = np.cumsum(size) - size
                columns = [key, size, np.repeat(key[first], count), before - np.repeat(before[first], count), np.repeat(np.add.reduceat(size, first), count)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "length", "sequence_id", "offset", "filled"])

    return run


def pack_blocks(items: DataFrame, blocks: int, capacity: int, islands: int = ISLANDS, members: int = MEMBERS, epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """(key, length, sequence_id, offset, filled) of items(key, length), packed block by block; stored."""
    by = ("length", F.xxhash64("key"), "key")  # a length of many pieces spans several ranges
    place = F.col("place") + 40_503 * F.shiftright("place", 33)
    dealt = items.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    listed = dealt.select(F.pmod(place, F.lit(blocks)).alias("block"), F.struct("length", "key").alias("item")).groupBy("block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))

    def sized(batches):
        for b in batches:
            out = [np.array([i["length"] for i in row], "<i4").tobytes() for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[i["key"] for i in row] for row in b.column(1).to_pylist()], pa.list_(pa.int64())), pa.array(out, pa.binary())], names=["block", "keys", "sizes"])

    stored = cut(listed.mapInArrow(sized, "block long, keys array<long>, sizes binary"))
    none = F.lit(None).cast("binary")
    state = stored.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", none.alias("members"), none.alias("guest"))
    state = cut(state.mapInArrow(_island(members, children, capacity, 0), STATE))
    for epoch in range(1, epochs):
        guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guest"))
        last, state = state, cut(state.join(guests, ["block", "island"]).select("block", "island", "sizes", "members", "guest").mapInArrow(_island(members, children, capacity, epoch), STATE))
        discard(last)
    best = state.groupBy("block").agg(F.max_by("best", F.struct("fitness", -F.col("island"))).alias("bins"))
    placed = cut(stored.join(best, "block").select("keys", "sizes", "bins").mapInArrow(_places(capacity), "key long, length long, sequence_id long, offset long, filled long"))
    discard(stored, state)
    return placed


def pack(items: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, **search) -> DataFrame:
    """(key, sequence_id, offset) of every row of items(key, length), a stored table with distinct keys and lengths of 1 to capacity.

    Pieces of a sequence lie side by side from offset 0 on, in the order of
    their keys; sequence_id is the smallest key of a sequence. Equal lengths are
    interchangeable; an empty table gives an empty result.
    """
    columns = ["key", "sequence_id", "offset"]
    full = items.where(F.col("length") == capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, out = items.where(F.col("length") < capacity).select("key", "length"), full
    n = rest.count()
    while n:
        blocks = math.ceil(n / block_pieces)
        placed = pack_blocks(rest, blocks, capacity, **search)
        loose = placed.where(F.col("filled") < WELL_FILLED * capacity)
        m = loose.count() if blocks > 1 else 0
        # Where most pieces lie in badly filled bins, their lengths are the reason and not the blocks.
        n = m if 2 * m <= n else 0
        out = out.unionByName((placed.where(F.col("filled") >= WELL_FILLED * capacity) if n else placed).select(columns))
        rest = loose.select("key", "length")
    return out


def stored_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """The table of pieces, written to the checkpoint folder."""
    path = scratch(docs.sparkSession, "pieces")
    pieces(docs, tokenizer_json, capacity, end_id).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): the pieces of docs with their places; see pieces and pack."""
    stored = stored_pieces(docs, tokenizer_json, capacity, end_id)
    return stored.join(pack(stored.select("key", "length"), capacity), "key").drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, length, ids): the packed sequences themselves, ids as in pieces."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("p"), F.sum("length").alias("length"))
    return held.select("sequence_id", F.size("p").alias("n_pieces"), "length", F.unhex(F.array_join(F.transform("p", lambda x: x["ids"]), "")).alias("ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document; null texts are their end id alone."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    stored = stored_pieces(table(spark, sf_dir, "documents"), spec)
    # Digests are taken where the ids lie, so that ids are not shuffled to their places.
    digests = stored.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(pack(stored.select("key", "length")), "key").drop("key")
