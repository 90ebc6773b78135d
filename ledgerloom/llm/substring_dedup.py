"""Substring dedup with a log-structured fingerprint index.

Documents come in batches. A batch becomes a sorted immutable run: its windows
in stretches that share an anchor, each stretch with the fingerprint of all its
words. The run is merge-joined with the runs that are stored, which lie in
buckets of the anchor, sorted, so that no stored row is shuffled. Equal
stretches are repeats at once; stretches that share an anchor and differ are
verified window by window on the words of their documents. Runs of similar size
are compacted to one.

The anchor of a window is the least hash among its 8-word grams (the first of
them on ties), so equal windows have equal anchors, and the about 14 windows
that share one anchor occurrence are one row. Anchor and fingerprint are 64-bit
hashes of independent lanes; windows are verified by 128 bits of both lanes.

What is common within a task's text is settled there: a stretch or window that
a task holds many times is sent once, and the places of its copies go past the
merge. A passage in a third of all documents so reaches the merge once a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import text_groups
from .common import cut, discard, names_in, only_ids, put_new, remove_path, scratch, small_batches, table
from .textnum import chunks, grams, mix, utf8, word_hashes

WINDOW_WORDS = 35
GRAM_WORDS = 8
#: Batches in which the registered query feeds the index.
BATCHES = 4
#: Text that a task settles at a time; its arrays take about 40 times that.
RUN_BYTES = 4 << 20

#: Rows of a run's bucket at most; a merged run gets more buckets then.
BUCKET_ROWS = 4_000_000
PLACE = ("row", "check", "first", "last")
SPAN = "row long, check int, first int, last int"
ENTRY = "anchor long, print long, row long, check int, first int, last int, copies int"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Positions of the first least value in every stretch of width values."""
    n = len(x) - width + 1
    at = np.arange(len(x))
    # By doubling: the least of 2, 4, 8 ... values, then of two overlapping stretches.
    reach = 1
    while reach * 2 <= width:
        a, b = at[: len(at) - reach], at[reach:]
        at = np.where(x[b] < x[a], b, a)
        reach *= 2
    if reach < width:
        a, b = at[:n], at[width - reach : width - reach + n]
        at = np.where(x[b] < x[a], b, a)
    return at[:n]


def _once(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries with equal (key, sum): the first ones, their counts, and which entries are of several."""
    order = np.lexsort((sums, keys))
    k, s = keys[order], sums[order]
    fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
    group = np.cumsum(fresh) - 1
    count = np.bincount(group)
    several = np.zeros(len(keys), bool)
    several[order] = count[group] > 1
    return order[fresh], count, several


def _columns(names: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _rows_of(batches) -> Iterator[tuple]:
    """(row, check, rest..., text in bytes) of the batches' rows, text last."""
    for b in batches:
        for lo, hi in text_groups(b.column(b.num_columns - 1)):
            *keys, texts = (c.slice(lo, hi - lo).to_pylist() for c in b.columns)
            yield from zip(*keys, map(utf8, texts), strict=True)


def _stretches(rows: list[tuple], window: int, gram: int):
    """Of rows (row, check, text): anchor, fingerprint, number of the row, first and last window of every stretch."""
    (a, b), bounds = word_hashes([r[-1] for r in rows], lanes=2)
    anchors = grams(a, gram)
    n = len(a) - window + 1
    if n <= 0:
        return None
    prints = grams(b, window, 1)
    least = sliding_min(anchors, window - gram + 1)[:n]
    doc = np.searchsorted(bounds, np.arange(n), side="right") - 1
    ok = np.arange(n) + window <= bounds[doc + 1]
    if not ok.any():
        return None
    new = ok & np.concatenate(([True], (least[1:] != least[:-1]) | ~ok[:-1] | (doc[1:] != doc[:-1])))
    starts = np.flatnonzero(new)
    of = np.cumsum(new)[ok] - 1
    sizes = np.bincount(of, minlength=len(starts))
    sums = np.zeros(len(starts), np.uint64)
    # The same windows in other places of a stretch are other stretches.
    np.add.at(sums, of, mix(prints[ok] + (np.flatnonzero(ok) - starts[of]).astype(np.uint64)))
    first = starts - bounds[doc[starts]]
    return anchors[least[starts]], mix(sums + sizes.astype(np.uint64)), doc[starts], first, first + sizes - 1


def _entries(window: int, gram: int, size: int):
    """ENTRY rows: a stretch and its copies in the task, and with a null print the places of all that have copies."""

    def run(batches):
        for part in chunks(_rows_of(batches), size):
            found = _stretches(part, window, gram)
            if found is None:
                continue
            anchor, print_, doc, first, last = found
            row, check = (np.array([r[k] for r in part], np.int64)[doc] for k in (0, 1))
            kept, count, several = _once(anchor, print_)
            yield _columns(ENTRY, _signed(anchor[kept]), _signed(print_[kept]), row[kept], check[kept], first[kept], last[kept], count)
            rest = np.flatnonzero(several)
            if len(rest):  # dealt by document
                yield _columns(ENTRY, _signed(mix(row[rest].view(np.uint64))), pa.nulls(len(rest), pa.int64()), row[rest], check[rest], first[rest], last[rest], np.ones(len(rest)))

    return run


def _windows(window: int, size: int):
    """Of rows (row, check, stretches, text): each window of the stretches, (a, b, row, check, at, copies), and with a null b the places of those with copies."""
    names = "a long, b long, row long, check int, at int, copies int"

    def run(batches):
        for part in chunks(_rows_of(batches), size):
            (a, b), bounds = word_hashes([r[-1] for r in part], lanes=2)
            a, b = grams(a, window), grams(b, window, 1)
            at = [np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in r[2]])) for r in part]
            doc = np.repeat(np.arange(len(part)), list(map(len, at)))
            at = np.concatenate(at)
            place = bounds[doc] + at
            a, b = a[place], b[place]
            row, check = (np.array([r[k] for r in part], np.int64)[doc] for k in (0, 1))
            kept, count, several = _once(a, b)
            yield _columns(names, _signed(a[kept]), _signed(b[kept]), row[kept], check[kept], at[kept], count)
            rest = np.flatnonzero(several)
            if len(rest):
                yield _columns(names, _signed(mix(row[rest].view(np.uint64))), pa.nulls(len(rest), pa.int64()), row[rest], check[rest], at[rest], np.ones(len(rest)))

    return run, names


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row and check, which tell texts apart: the doc_id (for null ids a hash of the text) and another hash of the text."""
    return docs.withColumn("row", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).withColumn("check", F.shiftright(F.xxhash64(F.lit(7), "text"), 32).cast("int"))


class FingerprintIndex:
    """Runs at a path, each a table (ENTRY, a row per anchor and fingerprint) in buckets of the anchor, sorted within.

    The folder of a run is named by its number, buckets and rows. The newest
    manifest names the runs that count, the last batch and where its results
    lie; it is put in place by a rename after all it names. Whatever else lies
    at the path was left by a job that was stopped, and goes when the index is
    opened: one index is open for adding at a time.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, run_bytes: int = RUN_BYTES):
        self.spark, self.path, self.window, self.gram, self.run_bytes = spark, path.rstrip("/"), window, gram, run_bytes
        self.tables: dict[str, str] = {}
        self.state = {"number": -1, "runs": [], "batch": None, "results": []}
        found = [n for n in names_in(spark, f"{self.path}/manifests") if n.isdigit()]
        if found:
            self.state = json.loads(spark.read.text(f"{self.path}/manifests/{found[-1]}", wholetext=True).first().value)
        for n in names_in(spark, self.path):
            if n != "manifests" and n not in self.runs:
                self._remove(n)
        for n in found[:-1]:
            self._remove(f"manifests/{n}")

    @property
    def runs(self) -> list[str]:
        return self.state["runs"]

    def _commit(self, **changed) -> None:
        """The next state, as a manifest; the one before it goes."""
        before = self.state["number"]
        state = self.state | changed | {"number": before + 1}
        put_new(self.spark, f"{self.path}/manifests/{state['number']:012d}", json.dumps(state))
        self.state = state
        if before >= 0:
            self._remove(f"manifests/{before:012d}")

    def _rows(self, run: str) -> int:
        return int(run.rsplit("-", 1)[1])

    def read(self, run: str) -> DataFrame:
        """A run as a bucketed table."""
        if run not in self.tables:
            name = f"fingerprints_{uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, print) INTO {run.split('-')[2]} BUCKETS LOCATION '{self.path}/{run}'")
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def _write(self, entries: DataFrame, buckets: int, kind: str = "run") -> str:
        number = int(self.runs[-1].split("-")[1]) + 1 if self.runs else 0
        made = f"{self.path}/making-{uuid4().hex}"
        name = f"fingerprints_{uuid4().hex}"
        entries.write.bucketBy(buckets, "anchor").sortBy("anchor", "print").option("path", made).saveAsTable(name)
        rows = self.spark.table(name).count()
        self.spark.sql(f"DROP TABLE {name}")
        run = f"{kind}-{number:09d}-{buckets}-{rows}"
        self._remove(run)
        paths = [self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (made, f"{self.path}/{run}")]
        if not paths[0].getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(*paths):
            raise RuntimeError(f"{made} could not be renamed to {run}")
        return run

    def _buckets(self, rows: int = 0) -> int:
        """Buckets of a new run of so many rows: those of the largest run, doubled while they would hold more than BUCKET_ROWS."""
        n = max((int(r.split("-")[2]) for r in self.runs), default=int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        while rows > n * BUCKET_ROWS:
            n *= 2
        return n

    def _remove(self, run: str) -> None:
        if run in self.tables:
            self.spark.sql(f"DROP TABLE {self.tables.pop(run)}")
        remove_path(self.spark, f"{self.path}/{run}")

    def close(self) -> None:
        """Takes the runs from the session's catalogue; their files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE {name}")
        self.tables = {}

    @contextmanager
    def _anchor_suffices(self):
        """Lets joins on anchor and fingerprint use the buckets of the anchor as they lie."""
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def add(self, docs: DataFrame, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Adds a batch docs(row, check, text): (repeats, doubtful).

        A job that was stopped adds its batch again under the same name: if it
        had come in as the last one, its stored results are given once more.

        repeats(row, check, first, last) are ranges of first words of repeated
        windows, of the batch and of earlier documents that had none like them
        before; doubtful has the same columns, for stretches to be verified on
        the words of the batch and of earlier documents.
        """
        if batch is not None and batch == self.state["batch"]:
            self.compact()
            repeats, doubtful = (self.spark.read.schema(SPAN).parquet(p) for p in self.state["results"])
            repeats._scratch_path, doubtful._scratch_path = self.state["results"]
            return repeats, doubtful
        buckets = self._buckets()
        entries = docs.where("text IS NOT NULL").select("row", "check", "text").mapInArrow(_entries(self.window, self.gram, self.run_bytes), ENTRY)
        raw_run = self._write(entries.repartition(buckets, "anchor"), buckets, "batch")
        raw = self.read(raw_run)
        least = F.min(F.struct(*PLACE))
        merged = raw.where("print IS NOT NULL").groupBy("anchor", "print").agg(least.alias("place"), F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"))
        run = self._write(merged.select("anchor", "print", "place.*", "copies"), buckets)
        new = self.read(run)
        equal = new.where("copies > 1").select("anchor", "print")
        spans = [raw.where("print IS NULL").select(*PLACE)]
        doubtful = [new.join(new.groupBy("anchor").count().where("count > 1").select("anchor"), "anchor", "left_semi").select(*PLACE)]
        for stored in self.runs:
            old = self.read(stored)
            same = new.select("anchor", "print").join(old, ["anchor", "print"])
            equal = equal.union(same.select("anchor", "print"))
            spans.append(same.where("copies = 1").select(*PLACE))
            counts = [t.groupBy("anchor").agg(F.count(F.lit(1)).alias(n)) for t, n in ((new, "n"), (old, "o"), (same, "s"))]
            mixed = counts[0].join(counts[1], "anchor").join(counts[2], "anchor", "left").where("n + o - coalesce(s, 0) > 1").select("anchor")
            doubtful += [t.join(mixed, "anchor", "left_semi").select(*PLACE) for t in (new, old)]
        spans.append(raw.where("print IS NOT NULL").join(equal, ["anchor", "print"], "left_semi").select(*PLACE))
        with self._anchor_suffices():
            out = [cut(reduce(DataFrame.union, parts)) for parts in (spans, doubtful)]
        self._commit(runs=[*self.runs, run], batch=batch, results=[t._scratch_path for t in out])
        self._remove(raw_run)
        self.compact()
        return out[0], out[1]

    def compact(self) -> None:
        """Merges the newest runs while they are of similar size, so that there are about as many runs as the logarithm of the batches."""
        while len(self.runs) > 1 and 2 * self._rows(self.runs[-1]) >= self._rows(self.runs[-2]):
            x, y = (self.read(r).select("anchor", "print", F.struct(*PLACE).alias("place"), "copies") for r in self.runs[-2:])
            both = x.alias("x").join(y.alias("y"), ["anchor", "print"], "full")
            copies = F.least(F.coalesce("x.copies", F.lit(0)) + F.coalesce("y.copies", F.lit(0)), F.lit(2)).cast("int")
            merged = both.select("anchor", "print", F.coalesce("x.place", "y.place").alias("place"), copies.alias("copies")).select("anchor", "print", "place.*", "copies")
            merging = self.runs[-2:]
            with self._anchor_suffices():
                run = self._write(merged, self._buckets(sum(map(self._rows, merging))))
            self._commit(runs=[*self.runs[:-2], run])
            for old in merging:
                self._remove(old)

    def verify(self, doubtful: DataFrame, docs: DataFrame) -> DataFrame:
        """(row, check, first, last): the windows of doubtful stretches that occur twice among them; docs(row, check, text) has all documents so far."""
        by = cut(doubtful.groupBy("row", "check").agg(F.collect_set(F.struct("first", "last")).alias("stretches")))
        ids = cut(by.select(F.col("row").alias("doc_id")).distinct())
        few = only_ids(docs.select("row", "check", "text", F.col("row").alias("doc_id")), ids)
        run, names = _windows(self.window, self.run_bytes)
        found = few.join(by, ["row", "check"]).select("row", "check", "stretches", "text").mapInArrow(run, names)
        twice = found.withColumn("n", F.sum("copies").over(Window.partitionBy("a", "b"))).where("b IS NULL OR n > 1")
        out = cut(twice.select("row", "check", F.col("at").alias("first"), F.col("at").alias("last")))
        discard(by, ids)
        return out


def _removal(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept", "removed"]

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = utf8(text).split()
                covered = np.zeros(len(words) + 1, np.int32)
                for s in spans or ():
                    covered[s["first"]] += 1
                    covered[s["last"] + window] -= 1
                gone = np.cumsum(covered[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
                out.append((len(words), int(gone.sum()), kept.decode("utf-8", "replace")))
            n, k, t = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(t, pa.string())], names=names[:4])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of docs(doc_id, text), a row per row.

    The documents go through an index in batches, dealt by their id; the result
    is the same for any number of them. Null and empty texts have no words. Rows
    are told apart by doc_id and text (null ids too), so repeated rows repeat
    each other and lose all windows. Words are compared unchanged; the kept ones
    are joined by single blanks. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    index = FingerprintIndex(spark, scratch(spark, "fingerprints"), window)
    repeats, doubtful = [], []
    for k in range(batches):
        found, open_ = index.add(base.where(F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(batches)) == k))
        repeats.append(found)
        doubtful.append(open_)
    index.close()
    remove_path(spark, index.path)
    repeats.append(index.verify(reduce(DataFrame.union, doubtful), base))
    discard(*doubtful)
    spans = reduce(DataFrame.union, repeats).groupBy("row", "check").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return base.join(spans, ["row", "check"], "left").select("doc_id", "text", "spans").mapInArrow(_removal(window), "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; null texts are empty, repeated rows repeat each other."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
