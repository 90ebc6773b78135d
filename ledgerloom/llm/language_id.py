"""Language identification: words first, then ever shorter character n-grams.

A known word scores its log frequency in each language. A word that training
has not seen falls back to its 4-grams (with word ends marked), if none of them
is known to its 3-grams, and so on. A text's score is the posterior of its best
language under equal priors.

Training counts in Spark over a bounded sample of the labelled documents, those
with the lowest hashes: MAX_TRAIN of them, or fewer, halved until the model has
MAX_UNITS words and n-grams at most. The model keeps every word and n-gram of
its sample, so its size is bounded by MAX_UNITS and it may be broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import text_groups
from .common import cut, discard, held, release, small_batches, table

MAX_TRAIN = 5_000
MAX_UNITS = 1_500_000
LONGEST = 4
SMOOTH = 0.5
UNDETERMINED = "und"
#: Below this posterior the corpus pipeline rejects a document.
LEAST_SCORE = 0.5
#: Log frequencies of unseen words that a worker remembers, over all languages.
MEMORY = 400_000
FOLDS, HELD_OUT = 5, 0
_WORDS = regex.compile(r"\p{L}+")
#: Words that a task counts before it sends them on.
MOST_COUNTED = 50_000


def words_of(text: str | None) -> list[str]:
    """The words of a text: its runs of letters, lower-cased."""
    return _WORDS.findall((text or "").lower())


def fold(column: str, folds: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def _word_counts(batches):
    """(lang, unit, count) of the rows (lang, text), summed over stretches of text."""
    release()
    found: Counter = Counter()

    def sent():
        langs, units = zip(*found, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(units, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "unit", "count"])
        found.clear()
        return batch

    for b in batches:
        for lo, hi in text_groups(b.column(1)):
            for lang, text in zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            if len(found) > MOST_COUNTED:
                yield sent()
    if found:
        yield sent()


def _grams_of(words: DataFrame, n: int) -> DataFrame:
    text = F.col("unit") if n == 1 else F.concat(F.lit("<"), "unit", F.lit(">"))
    cuts = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return words.where(F.length(text) >= n).select("lang", "count", F.explode(cuts).alias("unit"))


def _logs(counts: DataFrame, totals, langs: list[str]) -> pa.Table:
    """(unit, logs): log frequencies of each unit by language; totals gives a language's total as a column."""
    by = counts.groupBy("unit").agg(*(F.sum(F.when(F.col("lang") == lang, F.col("count")).otherwise(0)).alias(f"c{k}") for k, lang in enumerate(langs)))
    logs = [F.log((F.col(f"c{k}") + F.lit(SMOOTH)) / (totals(lang) + F.lit(SMOOTH))) for k, lang in enumerate(langs)]
    return by.select("unit", F.array(*logs).alias("logs")).toArrow()


def train(docs: DataFrame, most: int = MAX_TRAIN) -> dict:
    """The model of docs(doc_id, text, lang): languages, and log frequencies per language of words and n-grams.

    Rows without text, lang or doc_id teach nothing; rows that share a doc_id
    are all in the sample or none is. Without any row the model has no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    while True:
        chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()
        sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")
        words = cut(sample.mapInArrow(_word_counts, "lang string, unit string, count long").groupBy("lang", "unit").agg(F.sum("count").alias("count")))
        grams = _grams_of(words, 1)
        for n in range(2, LONGEST + 1):
            grams = grams.unionByName(_grams_of(words, n))
        grams = cut(grams.groupBy("lang", "unit").agg(F.sum("count").alias("count")))
        if most == 1 or words.select("unit").distinct().count() + grams.select("unit").distinct().count() <= MAX_UNITS:
            break
        discard(words, grams)
        most //= 2
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    sums = {(r.lang, r.length): r.n for r in grams.groupBy("lang", F.length("unit").alias("length")).agg(F.sum("count").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        discard(words, grams)
        return {"langs": [], "words": None, "grams": None}

    def gram_total(lang: str):
        of = F.lit(SMOOTH)
        for n in range(1, LONGEST + 1):
            of = F.when(F.length("unit") == n, F.lit(sums.get((lang, n), 0) + SMOOTH)).otherwise(of)
        return of

    model = {"langs": langs, "words": _ipc(_logs(words, lambda lang: F.lit(float(totals[lang])), langs)), "grams": _ipc(_logs(grams, gram_total, langs))}
    discard(words, grams)
    return model


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as writer:
        writer.write_table(t)
    return sink.getvalue().to_pybytes()


def _units(raw: bytes | None, width: int) -> tuple[dict[str, int], np.ndarray]:
    if raw is None:
        return {}, np.zeros((0, width))
    t = pa.ipc.open_stream(raw).read_all()
    logs = t.column("logs").combine_chunks()
    logs = logs.chunk(0) if isinstance(logs, pa.ChunkedArray) else logs
    return {u: k for k, u in enumerate(t.column("unit").to_pylist())}, logs.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Scorer:
    """A model as a table of log frequencies and the places of its words, and of the unseen words scored last."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.width = max(1, len(self.langs))
        self.place, self.table = _units(model["words"], self.width)
        self.grams, logs = _units(model["grams"], self.width)
        self.gram_logs = list(map(tuple, logs.tolist()))
        self.unseen: list[str] = []

    def backed_off(self, w: str) -> list[float]:
        """The scores of an unseen word: the mean over its longest known n-grams."""
        for n in range(LONGEST, 0, -1):
            text = w if n == 1 else f"<{w}>"
            found = [self.gram_logs[g] for i in range(len(text) - n + 1) if (g := self.grams.get(text[i : i + n])) is not None]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * self.width

    def _learn(self, words: set[str]) -> None:
        if len(self.unseen) * self.width > MEMORY:
            for w in self.unseen:
                del self.place[w]
            self.unseen = []
        new = list(words.difference(self.place))
        at = len(self.place)
        if at + len(new) > len(self.table):
            self.table = np.vstack([self.table[:at], np.zeros((len(new) + MEMORY // self.width, self.width))])
        if new:
            self.table[at : at + len(new)] = list(map(self.backed_off, new))
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
            self.unseen += new

    def score(self, texts: list) -> list[tuple[str, float]]:
        split = list(map(words_of, texts))
        self._learn(set().union(*split))
        out = []
        for words in split:
            if not words or not self.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.table[list(map(self.place.__getitem__, words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def predict(docs: DataFrame, model: dict, lang: str = "lang_pred", score: str = "score", text: str = "text") -> DataFrame:
    """docs with the language and score of each whole text, in columns of the given names.

    A text that is null, empty or without a letter is `und` with score 0, as is
    any text under a model without languages. On ties the first language by
    name wins. Rows and all other columns stay, repeated rows too; columns named
    as the results are replaced. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid4().hex
    base = docs.drop(lang, score)
    place = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = held(key, lambda: Scorer(shared.value))
        for b in batches:
            texts = b.column(place)
            for lo, hi in text_groups(texts):
                langs, scores = zip(*scorer.score(texts.slice(lo, hi - lo).to_pylist()), strict=True)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang, score])

    return base.mapInArrow(run, StructType([*base.schema.fields]).add(lang, "string").add(score, "double"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learnt from the labelled rows of the other folds.

    A row without doc_id is held out. Null, empty and letterless texts are
    `und`; repeated rows are predicted alike; an empty table gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", FOLDS) != HELD_OUT).select("doc_id", "text", "lang"))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(True))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
