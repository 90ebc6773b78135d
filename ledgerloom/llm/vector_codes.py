"""Vector code compression: a codebook for each part of the vectors, trained with norm-of-sum bounds.

Lloyd's rounds on integer vectors. Of each part a row keeps its entry, an upper
bound on the distance to it and a lower bound on the distance to every other
entry, each with the number of the round in which it was measured. All
codebooks so far are retained, so that a bound is carried over by the distance
between its entry's place then and now, the norm of the sum of its moves, which
is never more than the sum of the moves' norms. Only parts whose bounds then
meet are measured: first the own entry alone, then, if still in doubt, all
entries. Comparisons that decide are made on integers; bounds only ever say that
no decision is needed, with a margin for their rounding.

A round is one pass over the stored state and one over its parts and codes; the
driver gets entries * components sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, discard, table
from .integer_vectors import LIMIT, ROWS, SLACK, as_binary, finite, from_binary, group_sums, integers, moved_means, rows_of, to_all, to_own

SCALE, PARTS, ENTRIES, ROUNDS = 4_096, 8, 16, 6
#: Groups of a label table that are broadcast at most.
MAX_BROADCAST = 100_000
#: Stamp of a bound that has not been measured.
NEVER = -1


class Bounds:
    """Codes of n rows of one part with their bounds and stamps."""

    def __init__(self, n: int):
        self.code = np.zeros(n, np.uint8)
        self.upper, self.lower = np.full(n, np.inf, np.float32), np.zeros(n, np.float32)
        self.upper_at, self.lower_at = np.full(n, NEVER, np.int8), np.full(n, NEVER, np.int8)


def displacements(history: np.ndarray) -> np.ndarray:
    """(rounds, entries): how far each entry of history(rounds, entries, width) is now from its place in each round."""
    return np.sqrt(np.square(history - history[-1]).sum(axis=2).astype(np.float64))


def carried(b: Bounds, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds as they hold now: apart by the net move of the own entry and by the largest one of the others."""
    up = b.upper + moved[b.upper_at, b.code]
    others = np.repeat(moved[:, None], moved.shape[1], axis=1)
    others[:, np.arange(moved.shape[1]), np.arange(moved.shape[1])] = 0
    low = b.lower - others.max(axis=2)[b.lower_at, b.code]
    never = (b.upper_at == NEVER) | (b.lower_at == NEVER)
    return np.where(never, np.inf, up), np.where(never, -np.inf, low)


def reassign(x: np.ndarray, b: Bounds, history: np.ndarray) -> None:
    """Sets b to the nearest entry of history's last codebook, the lower index on ties, for each row of x."""
    now, books = len(history) - 1, history[-1]
    up, low = carried(b, displacements(history))
    doubt = np.flatnonzero(~(up < low))
    own = np.sqrt(to_own(x[doubt], books[b.code[doubt]]).astype(np.float64)) * (1 + SLACK)
    known = b.upper_at[doubt] != NEVER
    b.upper[doubt[known]], b.upper_at[doubt[known]] = own[known], now
    doubt = doubt[~(own < low[doubt])]
    for lo in range(0, len(doubt), ROWS):
        at = doubt[lo : lo + ROWS]
        d = to_all(x[at], books)
        best = d.argmin(axis=1)
        rows = np.arange(len(at))
        b.code[at], b.upper[at] = best, np.sqrt(d[rows, best].astype(np.float64)) * (1 + SLACK)
        if len(books) > 1:
            d[rows, best] = np.iinfo(np.int64).max
            b.lower[at] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)
        else:
            b.lower[at] = np.inf
        b.upper_at[at] = b.lower_at[at] = now


def _round(history: np.ndarray, parts: int, fresh: bool):
    """A pass over rows (id, label, v[, code, bounds, stamps]); history(rounds, parts, entries, width)."""
    names = ["vec_id", "label", "v", "code", "bounds", "stamps"]

    def run(batches):
        for batch in batches:
            x = rows_of(batch.column(2)).reshape(batch.num_rows, parts, -1) if batch.num_rows else np.zeros((0, parts, history.shape[3]), np.int64)
            n = len(x)
            code, bounds, stamps = np.zeros((n, parts), np.uint8), np.zeros((n, 2, parts), np.float32), np.zeros((n, 2, parts), np.int8)
            if not fresh and n:
                code, bounds, stamps = from_binary(batch.column(3), "u1"), from_binary(batch.column(4), "<f4").reshape(n, 2, parts), from_binary(batch.column(5), "i1").reshape(n, 2, parts)
            for p in range(parts if n else 0):
                b = Bounds(n)
                if not fresh:
                    b.code, b.upper, b.lower, b.upper_at, b.lower_at = (np.ascontiguousarray(c) for c in (code[:, p], bounds[:, 0, p], bounds[:, 1, p], stamps[:, 0, p], stamps[:, 1, p]))
                reassign(x[:, p], b, history[:, p])
                code[:, p], bounds[:, 0, p], bounds[:, 1, p], stamps[:, 0, p], stamps[:, 1, p] = b.code, b.upper, b.lower, b.upper_at, b.lower_at
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], as_binary(code), as_binary(bounds.reshape(n, -1)), as_binary(stamps.reshape(n, -1))], names=names)

    return run


def _final(books: np.ndarray, parts: int):
    """Rows (id, label, code, error) of a pass's result, the error measured on the entries."""

    def run(batches):
        for batch in batches:
            n, error = batch.num_rows, np.zeros(batch.num_rows, np.int64)
            if n:
                x, code = rows_of(batch.column(2)).reshape(n, parts, -1), from_binary(batch.column(3), "u1")
                for p in range(parts):
                    error += to_own(x[:, p], books[p][code[:, p]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


class Coded:
    """What compress returns: rows(vec_id, label, code binary, error), the codebooks of every round, and the parts that each round measured against all entries."""

    def __init__(self, rows: DataFrame, history: np.ndarray, scans: list[int]):
        self.rows, self.history, self.scans = rows, history, scans

    @property
    def books(self) -> np.ndarray:
        """(parts, entries, width)."""
        return self.history[-1]


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> Coded:
    """A code of one byte a part for each vector of df(vec_id, vector, label).

    Vectors that are null or hold null, NaN, infinite components or such of
    LIMIT / scale and more are left out, as are those whose length is not that
    of the kept vector with the smallest id or can't be cut into equal parts.
    The codebooks start from the smallest ids (rows that repeat an id by their
    components, null ids last); with fewer rows there are fewer entries. Equal
    vectors get equal codes; an empty table gives no rows and no codebooks.
    Other columns are ignored.
    """
    if not (1 <= entries <= 256 and rounds < 127):
        raise ValueError("a code and a stamp have one byte: 1 to 256 entries, fewer than 127 rounds")
    spark, v = df.sparkSession, F.col("v")
    source = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    source = source.where(finite(v, scale) & (F.size(v) > 0) & (F.size(v) % parts == 0)).select("vec_id", "label", integers(v, scale).alias("v"))
    by_id = (F.col("vec_id").asc_nulls_last(), "v")
    first = source.orderBy(*by_id).limit(1).collect()
    fields = StructType(source.schema.fields[:2])
    if not first:
        return Coded(spark.createDataFrame([], fields.add("code", "binary").add("error", "long")), np.zeros((1, parts, 0, 0), np.int64), [])
    length = len(first[0].v)
    source = source.where(F.size("v") == length)
    start = np.array([r.v for r in source.orderBy(*by_id).limit(entries).collect()], np.int64)
    history = start.reshape(1, len(start), parts, -1).swapaxes(1, 2)
    width, k = length // parts, len(start)
    schema = StructType([*source.schema.fields]).add("code", "binary").add("bounds", "binary").add("stamps", "binary")
    state, scans = None, []
    for _ in range(rounds):
        last, state = state, cut((state or source).mapInArrow(_round(history, parts, state is None), schema))
        now = len(history) - 1

        def members(batch, now=now):
            n = batch.num_rows
            groups = from_binary(batch.column(1), "u1").astype(np.int64) + np.arange(parts) * k
            measured = from_binary(batch.column(2), "i1").reshape(n, 2, parts)[:, 1] == now
            return rows_of(batch.column(0)).reshape(n * parts, width), groups.ravel(), measured.ravel()

        sums = group_sums(state.select("v", "code", "stamps"), parts * k, width, members)
        scans.append(sum(m for _, m, _ in sums))
        history = np.concatenate((history, moved_means(history[-1].reshape(parts * k, width), sums).reshape(1, parts, k, width)))
        if last is not None:
            discard(last)
    ended = (state or source).mapInArrow(_round(history, parts, state is None), schema)
    rows = cut(ended.mapInArrow(_final(history[-1], parts), fields.add("code", "binary").add("error", "long")))
    if state is not None:
        discard(state)
    return Coded(rows, history, scans)


def decode(coded: Coded, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): what the codes stand for, each component the middle of its step."""
    books = F.array(*(F.array(*(F.array(*((F.lit((int(c) + 0.5) / scale)) for c in entry)) for entry in book)) for book in coded.books))
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(coded.books) - 1)), lambda p: F.get(F.get(books, p), F.conv(F.substring(F.hex("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    return coded.rows.select("vec_id", F.flatten(parts).alias("vector"))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows(label, error, ...) with label_error, the error summed over equal labels, nulls together."""
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    few = totals.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return rows.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that compress keeps."""
    coded = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(coded.rows).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(coded.books)).alias("codebooks_sha256"))
