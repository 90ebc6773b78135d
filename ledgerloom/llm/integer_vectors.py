"""What the operators on integer vectors share: rounding down, rows between Arrow and numpy, sums of groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components at or beyond this stay out, as squared distances of 64 bits need it.
LIMIT = 1 << 28
#: Rows whose distances to all centres are held at a time.
ROWS = 2_048
#: Bounds are kept in 32 bits; so much is added to upper and taken off lower ones.
SLACK = 1e-6


def finite(vector: Column, scale: int) -> Column:
    """Whether a vector is there and all its components are numbers that stay below LIMIT when scaled."""
    inside = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(LIMIT / scale), F.lit(False)))
    return F.coalesce(vector.isNotNull() & inside, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), of x as double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64, copy=False)


def as_binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def from_binary(column: pa.Array, kind: str) -> np.ndarray:
    """A matrix of the bytes of each row, all equally long."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1).copy()


def to_all(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row to all centres."""
    return np.square(x[:, None] - centres[None]).sum(axis=2)


def to_own(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the centre in its place."""
    return np.square(x - centres).sum(axis=1)


def group_sums(stored: DataFrame, groups: int, width: int, group_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int, list[int]]]:
    """(members, marked, sums of components) of groups 0 to groups - 1.

    group_of gives of a batch its rows (n, width), their groups and 0/1 marks.
    Each task adds up its rows and hands on a number per group and component;
    Spark adds those in decimals, and groups * width sums reach the driver.
    """

    def add(batches):
        total, n, marked = np.zeros((groups, width), np.int64), np.zeros(groups, np.int64), np.zeros(groups, np.int64)
        for b in batches:
            if b.num_rows:
                x, g, m = group_of(b)
                order = np.argsort(g, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(g[order]) != 0])
                total[g[order][first]] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(g, minlength=groups)
                marked += np.bincount(g[m > 0], minlength=groups)
        held = np.flatnonzero(n)
        g, at = np.repeat(held, width), np.tile(np.arange(width), len(held))
        columns = [pa.array(c, pa.int64()) for c in (g, at, n[g], marked[g], total[g, at])]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "at", "n", "marked", "total"])

    parts = stored.mapInArrow(add, "g long, at long, n long, marked long, total long")
    exact = parts.groupBy("g", "at").agg(F.sum("n").alias("n"), F.sum("marked").alias("marked"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [(0, 0, [0] * width) for _ in range(groups)]
    for r in exact.collect():
        out[r.g] = (r.n, r.marked, out[r.g][2])
        out[r.g][2][r.at] = int(r.total)
    return out


def moved_means(centres: np.ndarray, sums: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """The floor of each group's mean; a group without members keeps its centre."""
    return np.array([[s // n for s in total] if n else list(c) for c, (n, _, total) in zip(centres.tolist(), sums, strict=True)], np.int64).reshape(centres.shape)
