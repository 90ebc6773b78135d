"""Quality classifier by positive-unlabelled learning.

A linear model over binned text statistics and hashed n-grams of words and
characters minimises the non-negative unbiased risk: with class prior p,
positives P and unlabelled U,
p * E_P[loss(g)] + max(0, E_U[loss(-g)] - p * E_P[loss(-g)]), with logistic
loss. Positives are all trusted documents of label 1, unlabelled are all
documents, whatever their label; no row is sampled.

The prior is estimated: a first model, fitted on one half of the documents,
tells P from U, and on the other half p is the least
U(score >= t) / P(score >= t) over thresholds t that keep a fair part of P, as
no set can hold less of U than p times what it holds of P.

Features are written once; every Newton round is one distributed pass that sums
losses, slopes and curvature, task by task and then in groups of tasks, so that
the driver reads a few matrices of fixed size. Where a step would make the risk
of negatives less than zero it is halved, at last left out.
"""

from __future__ import annotations

import pickle
from math import ceil, sqrt
from operator import eq
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .bpe import text_groups
from .common import cut, discard, held, small_batches, table
from .language_id import fold
from .textnum import utf8, word_hashes

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Where no positives or no documents are known.
DEFAULT_PRIOR = 0.8
BINS, WORD_BUCKETS, GRAM_BUCKETS, GRAM_BYTES = 8, 128, 128, 3
FIRST_ROUNDS, ROUNDS = 5, 8
#: Weights have a normal prior of this precision: a penalty that fades as documents grow in number.
PRECISION = 5.0
#: The prior's thresholds keep at least this part of the positives.
LEAST_KEPT = 0.5
NAMES = ("log_words", "distinct", "repeated_next", "word_bytes", "long_words", "upper", "digits", "pipes", "bangs", "marks", "stops", "high", "lines", "same_lines", "controls")
HASHED = WORD_BUCKETS + GRAM_BUCKETS
WIDTH = len(NAMES) * BINS + HASHED + 1
_UPPER, _DIGITS, _HIGH = slice(65, 91), slice(48, 58), slice(128, 256)
#: Bytes counted as marks: punctuation of code and tables rather than prose.
_MARKS = list(b"#$%&*@^_~=+<>{}[]\\")


def features(text: str | None) -> list[float]:
    """Statistics of a whole text; an empty one has zeros."""
    raw = utf8(text)
    if not raw:
        return [0.0] * len(NAMES)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.lower().split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[_HIGH].sum()))
    return [
        float(np.log1p(len(words))),
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        (n - m) / m,
        sum(len(w) > 24 for w in words) / m,
        counts[_UPPER].sum() / letters,
        counts[_DIGITS].sum() / n,
        counts[124] / m,
        counts[33] / m,
        counts[_MARKS].sum() / n,
        (counts[46] + counts[44]) / m,
        counts[_HIGH].sum() / n,
        len(lines) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        counts[:32].sum() / n,
    ]


def hashed(texts: list[bytes]) -> np.ndarray:
    """Of each text the roots of the shares of its words and 3-byte grams in their buckets, in 255ths."""
    out = np.zeros((len(texts), HASHED), np.uint8)
    (words,), bounds = word_hashes(texts, lower=True)
    buckets = (words >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if hi > lo:
            out[k, :WORD_BUCKETS] = np.rint(255 * np.sqrt(np.bincount(buckets[lo:hi], minlength=WORD_BUCKETS) / (hi - lo)))
        raw = np.frombuffer(texts[k].lower(), np.uint8)
        if len(raw) >= GRAM_BYTES:
            g = (raw[2:].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[:-2]) * np.uint32(2654435761) >> np.uint32(25)
            out[k, WORD_BUCKETS:] = np.rint(255 * np.sqrt(np.bincount(g, minlength=GRAM_BUCKETS) / len(g)))
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, stats, grams)."""

    def run(batches):
        for b in batches:
            for lo, hi in text_groups(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(map(features, texts), pa.list_(pa.float64())), pa.array([r.tobytes() for r in hashed(list(map(utf8, texts)))], pa.binary())], names=["doc_id", "stats", "grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>, grams binary")


class Model:
    """Bin edges per statistic, and the weights of bins, buckets and the constant."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, prior: float):
        self.edges, self.weights, self.prior = edges, weights, prior

    def design(self, stats: np.ndarray, grams_: np.ndarray) -> np.ndarray:
        x = np.zeros((len(stats), WIDTH), np.float32)
        rows = np.arange(len(stats))
        for k, (e, c) in enumerate(zip(self.edges, stats.T, strict=True)):
            x[rows, k * BINS + np.searchsorted(e, c, side="right")] = 1
        x[:, len(NAMES) * BINS : -1] = grams_.astype(np.float32) / 255
        x[:, -1] = 1
        return x

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights.astype(np.float32), -30, 30).astype(float)


def _matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stats = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    return stats, np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, HASHED), b.column(2).to_numpy(zero_copy_only=False).astype(bool)


def _summed(parts: list[dict]) -> dict:
    return {k: sum(p[k] for p in parts) for k in parts[0]} if parts else {}


def _pass(rows: DataFrame, sums) -> dict:
    """The sum of sums(stats, grams, positive) over all rows(stats, grams, positive), in a tree of tasks."""

    def first(batches):
        parts: dict = {}
        for b in batches:
            if b.num_rows:
                parts = _summed([p for p in (parts, sums(*_matrix(b))) if p])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], names=["part"])

    def again(batches):
        parts: dict = {}
        for b in batches:
            for raw in b.column(0).to_pylist():
                parts = _summed([p for p in (parts, pickle.loads(raw)) if p])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], names=["part"])

    n = rows.rdd.getNumPartitions()
    out = rows.mapInArrow(first, "part binary")
    while n > 16:
        n = ceil(sqrt(n))
        out = out.repartition(n).mapInArrow(again, "part binary")
    return _summed([pickle.loads(r.part) for r in out.collect()])


def _newton(rows: DataFrame, model: Model, prior: float | None, rounds: int) -> None:
    """Moves the weights to the least risk; without a prior, to those that tell P from U."""
    spark = rows.sparkSession
    step, fair = np.zeros(WIDTH), model.weights
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.edges, model.weights))

        def sums(stats, grams_, positive):
            m = Model(*shared.value, 0)
            x = m.design(stats, grams_)
            g = m.margins(x)
            s = 1 / (1 + np.exp(-g))
            curve = s * (1 - s)
            out = {"n": len(g), "n_p": int(positive.sum()), "u": float(np.logaddexp(0, g).sum()), "p": float(np.logaddexp(0, g[positive]).sum()), "x_p": x[positive].sum(axis=0, dtype=float), "slope": s @ x, "curve": (x * curve[:, None].astype(np.float32)).T @ x}
            if prior is None:
                out |= {"slope_p": s[positive] @ x[positive], "curve_p": (x[positive] * curve[positive, None].astype(np.float32)).T @ x[positive]}
            return out

        t = _pass(rows, sums)
        shared.unpersist()
        if not t or not t["n_p"]:
            return
        if prior is None:
            slope, curve = t["slope"] / t["n"] + (t["slope_p"] - t["x_p"]) / t["n_p"], t["curve"] / t["n"] + t["curve_p"] / t["n_p"]
        elif t["u"] / t["n"] - prior * t["p"] / t["n_p"] < 0:  # the last step went too far
            step = step / 2
            model.weights = fair + step
            continue
        else:
            fair = model.weights
            slope, curve = t["slope"] / t["n"] - prior * t["x_p"] / t["n_p"], t["curve"] / t["n"]
        decay = PRECISION / t["n"]
        step = -np.linalg.solve(curve.astype(float) + decay * np.eye(WIDTH), slope + decay * model.weights)
        step *= min(1.0, 20 / max(1e-12, np.abs(step).max()))
        model.weights = model.weights + step
    if prior is not None:
        model.weights = fair  # the last weights whose risk is known


def estimated_prior(rows: DataFrame, model: Model) -> float:
    """The least share of U over that of P above a threshold of the model's margins."""
    shared = rows.sparkSession.sparkContext.broadcast((model.edges, model.weights))
    cells = 2_000

    def sums(stats, grams_, positive):
        m = Model(*shared.value, 0)
        at = ((m.margins(m.design(stats, grams_)) + 30) / 60 * (cells - 1)).astype(int)
        return {"u": np.bincount(at, minlength=cells), "p": np.bincount(at[positive], minlength=cells)}

    t = _pass(rows, sums)
    if not t or not t["p"].sum():
        return DEFAULT_PRIOR
    u, p = (np.cumsum(t[k][::-1]) / t[k].sum() for k in ("u", "p"))
    fair = p >= LEAST_KEPT
    return float(np.clip((u[fair] / p[fair]).min(), 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs(doc_id, text) and labels(doc_id, quality); both hold only what one may learn from.

    Labels that are null or of unknown documents teach nothing; a document with
    several labels is a positive if one of them is 1. Without positives or
    documents every score is DEFAULT_PRIOR.
    """
    small_batches(docs.sparkSession)
    positive = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("positive", F.lit(True))
    rows = cut(with_features(docs.select("doc_id", "text")).join(positive, "doc_id", "left").select("stats", "grams", F.coalesce("positive", F.lit(False)).alias("positive"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("half")))
    at = [k / (BINS - 1) for k in range(1, BINS - 1)]
    cuts = rows.agg(*(F.percentile_approx(F.when(F.col("stats")[k] > 0, F.col("stats")[k]), F.lit(at), F.lit(10_000)).alias(n) for k, n in enumerate(NAMES))).first()
    # Zero has a bin of its own; the others split what is above it evenly.
    edges = np.array([[1e-12, *(cuts[n] or [1.0] * len(at))] for n in NAMES])
    first = Model(edges, np.zeros(WIDTH), DEFAULT_PRIOR)
    columns = ["stats", "grams", "positive"]
    _newton(rows.where("half").select(columns), first, None, FIRST_ROUNDS)
    prior = estimated_prior(rows.where("NOT half").select(columns), first)
    model = Model(edges, np.zeros(WIDTH), prior)
    model.weights[-1] = np.log(prior / (1 - prior))
    _newton(rows.select(columns), model, prior, ROUNDS)
    discard(rows)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on) of each whole text.

    Null texts are scored as empty ones. Rows and other columns stay, repeated
    rows too; columns named as the results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.weights, model.prior))
    base = docs.drop("score", "predicted")
    place = base.columns.index("text")
    key = uuid4().hex

    def run(batches):
        here = held(key, lambda: Model(*shared.value))
        for b in batches:
            for lo, hi in text_groups(b.column(place)):
                part = b.slice(lo, hi - lo)
                texts = part.column(place).to_pylist()
                x = here.design(np.array(list(map(features, texts))), hashed(list(map(utf8, texts))))
                s = 1 / (1 + np.exp(-here.margins(x)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return base.mapInArrow(run, StructType([*base.schema.fields]).add("score", "double").add("predicted", IntegerType()))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows without doc_id are held out, null texts scored as empty."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs.where(fold("doc_id", FOLDS) != HELD_OUT), labels.where(fold("doc_id", FOLDS) != HELD_OUT))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(True))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
