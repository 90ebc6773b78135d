"""Personal data by patterns of form and by bootstrapped context.

Four kinds have a form of their own: e-mail and IP addresses, payment cards,
phone numbers. They are the seeds. The words around a seed, with its shape and
without, are lexical patterns; a graph joins patterns with the strings that
occur in them. Spark scores that graph in rounds: a pattern is as good as the
share of known identifiers among its strings, a string as likely as one of its
patterns is right, and a string that is accepted makes patterns like a seed.
Strings that only look like identifiers (national phone numbers, digit runs that
fail a check, addresses with odd characters) and occur in patterns of high
confidence are added as spans. Spans of the forms always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import text_groups
from .common import cut, small_batches, table, unused

KINDS = ("email", "ip", "card", "phone")
#: Rounds at most; they end when a round accepts no new string.
ROUNDS = 10
#: A pattern counts from so many distinct seeds or accepted strings on, and shrinks its score by PRIOR strings that are none.
LEAST_SEEDS, PRIOR = 3, 2.0
#: A candidate is added from this likelihood on.
ACCEPT = 0.8
#: A longer word of a pattern stands in it by its digest.
LONGEST_WORD = 24

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile(r"\+?[0-9](?:[ ().\-/]{0,2}[0-9]){5,}")
_NAME = re.compile(r"[^\s@]+")
_TOKEN = re.compile(r"\S+")
_TRIM = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @: the name is the run of its characters before, as far as the last match."""
    out, last = [], 0
    if "@" not in text:
        return out
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    fit = lambda p: len(q := p.lstrip("0")) < 3 or len(q) == 3 and q <= "255"
    return [m.span() for m in _IP.finditer(text) if all(map(fit, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of all kinds, kind by kind and then by start; offsets in code points."""
    numbers = _DIGIT.search(text) is not None
    found = (emails(text), ips(text) if numbers else [], cards(text) if numbers else [], phones(text) if numbers else [])
    return [(kind, a, b) for kind, spans in zip(KINDS, found, strict=True) for a, b in spans]


def shape(s: str) -> str:
    """Letters as a, digits as 0, runs as one; other characters themselves."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]", "a", s)))


def _word(w: str) -> str:
    """A word of a pattern: without marks at its ends, in small letters, digits as one 0."""
    if not w:
        return "^"
    w = re.sub(r"[0-9]+", "0", w.strip(_TRIM).lower() or w)
    return w if len(w) <= LONGEST_WORD else "#" + blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that look like an address or a number, without marks at their ends, by start."""
    found = []
    if "@" in text:
        names = [m.span() for m in _NAME.finditer(text)]
        found += [(x[0], y[1]) for x, y in zip(names, names[1:], strict=False) if x[1] + 1 == y[0] and text[x[1]] == "@"]
    found += [m.span() for m in _NUMBER.finditer(text)]
    out, last = [], 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a < last:
            continue
        last = b
        raw = text[a:b]
        a, b = a + len(raw) - len(raw.lstrip(_TRIM)), b - len(raw) + len(raw.rstrip(_TRIM))
        if b - a >= 6:
            out.append((a, b))
    return out


def mentions(text: str, spans: list) -> list[dict]:
    """Seeds and candidates of a text with their context: kind (null for candidates), start, end, value, left, right, shape.

    Left and right are the words beside the string, as far as the strings
    before and after it; at an end of the text there is none.
    """
    taken = sorted((a, b) for _, a, b in spans)
    found = list(spans)
    if "@" in text or _DIGIT.search(text):
        k = 0
        for a, b in candidates(text):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if not (k < len(taken) and taken[k][0] < b):
                found.append((None, a, b))
    if not found:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [t[0] for t in tokens]
    edges_a, edges_b = sorted(f[1] for f in found), sorted(f[2] for f in found)
    out = []
    for kind, a, b in found:
        k = bisect_left(starts, a) - 1
        left = text[max(tokens[k][0], before[-1] if (before := edges_b[max(0, bisect_right(edges_b, a) - 1) : bisect_right(edges_b, a)]) else 0) : min(tokens[k][1], a)] if k >= 0 else ""
        k = bisect_right(starts, b - 1) - 1
        k += k < 0 or tokens[k][1] <= b
        after = edges_a[bisect_left(edges_a, b) : bisect_left(edges_a, b) + 1]
        right = text[max(tokens[k][0], b) : min(tokens[k][1], after[0] if after else len(text))] if k < len(tokens) else ""
        value = text[a:b]
        out.append({"kind": kind, "first": a, "last": b, "value": value, "left": _word(left), "right": _word(right), "shape": shape(value)})
    return out


_MENTION = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("value", pa.string()), ("left", pa.string()), ("right", pa.string()), ("shape", pa.string())])
_SPAN = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
FOUND = "base array<struct<kind: string, first: int, last: int>>, mentions array<struct<kind: string, first: int, last: int, value: string, left: string, right: string, shape: string>>"


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the base spans and the mentions of each whole text; null texts have none."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    base = docs.select(*rest, text)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo, hi in text_groups(b.column(len(rest))):
                part = b.slice(lo, hi - lo)
                spans, seen = [], []
                for t in part.column(len(rest)).to_pylist():
                    found = base_spans(t) if t else []
                    spans.append([{"kind": k, "first": a, "last": z} for k, a, z in found])
                    seen.append(mentions(t, found) if t else [])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(spans, pa.list_(_SPAN)), pa.array(seen, pa.list_(_MENTION))], names=[*rest, "base", "mentions"])

    schema = StructType([docs.schema[c] for c in rest])
    return base.mapInArrow(run, StructType([*schema.fields, *StructType.fromDDL(FOUND).fields]))


def likely(found: DataFrame) -> DataFrame:
    """(value, kind): the candidates that the pattern graph takes for identifiers.

    A context is the word before, the word after or the pair of both, with or
    without an @ in the string; a pattern is a context of any shape, or one of a
    single word with the string's shape. A string at an end of its text has the
    word of its other side only. Edges of the graph are distinct (pattern,
    string) pairs, so a string or a passage that is copied thousands of times
    counts once. Each round takes the patterns anew from the seeds and the
    strings accepted so far, and scores patterns by the share of these and strings,
    for each kind, by the best pattern of each of their contexts. Strings not yet
    accepted add their scores to patterns with a shape only, so that strings of
    any shape cannot lift one another.
    """
    m = found.select(F.explode("mentions").alias("m")).select("m.*")
    form = F.when(F.contains("value", F.lit("@")), "@").otherwise("0")
    word = {side: F.when(F.col(side) != "^", F.col(side)) for side in ("left", "right")}
    context = F.array_compact(F.array(*(F.when(w.isNotNull(), F.concat_ws("\u0001", F.lit(side), form, w)) for side, w in (("l", word["left"]), ("r", word["right"]), ("p", F.concat(word["left"], F.lit("\u0001"), word["right"]))))))
    contexts = m.select(F.explode(context).alias("context"), "value", "shape", "kind").distinct()
    shaped = F.when(~F.startswith("context", F.lit("p")), F.concat_ws("\u0001", "context", "shape"))
    edges = cut(contexts.select(F.explode(F.array_compact(F.array("context", shaped))).alias("pattern"), "context", "value", "kind"))
    strings = cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("strings")).where(F.col("strings") >= LEAST_SEEDS))
    seeds = cut(edges.where("kind IS NOT NULL").select("value", "kind", F.col("kind").alias("likely_kind"), F.lit(1.0).alias("score")).distinct())
    scores = seeds
    accepted = 0
    for _ in range(ROUNDS):
        known = scores.select(F.col("value").alias("v"), F.col("kind").alias("k"), "likely_kind", "score")
        linked = edges.join(known, F.expr("value = v AND kind <=> k"))
        sure, has_shape = F.col("score") >= ACCEPT, F.col("pattern") != F.col("context")
        sums = linked.groupBy("pattern", "likely_kind").agg(F.count_if(sure).alias("n"), F.sum(F.when(sure | has_shape, F.col("score")).otherwise(F.lit(0.0))).alias("right"))
        best = sums.where(F.col("n") >= LEAST_SEEDS).groupBy("pattern").agg(F.max_by(F.struct("likely_kind", "right"), F.struct("n", "likely_kind")).alias("best"))
        patterns = cut(best.join(strings, "pattern").select("pattern", "best.likely_kind", (F.col("best.right") / (F.col("strings") + PRIOR)).alias("strength")))
        by_context = edges.where("kind IS NULL").join(patterns, "pattern").groupBy("value", "likely_kind", "context").agg(F.max("strength").alias("strength"))
        doubt = F.log(F.greatest(1 - F.col("strength"), F.lit(1e-9)))
        by_value = by_context.groupBy("value", "likely_kind").agg((1 - F.exp(F.sum(doubt))).alias("score"))
        scores = cut(seeds.unionByName(by_value.select("value", F.lit(None).cast("string").alias("kind"), "likely_kind", "score")))
        before, accepted = accepted, scores.where(F.col("kind").isNull() & (F.col("score") >= ACCEPT)).count()
        if accepted == before:
            break
    good = scores.where(F.col("kind").isNull() & (F.col("score") >= ACCEPT))
    return good.groupBy("value").agg(F.max_by("likely_kind", F.struct("score", "likely_kind")).alias("kind"))


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with base and spans: arrays of (kind, first, last), by kind as in KINDS and then by start.

    base has the spans of the forms, spans those and the ones the pattern graph
    adds. Null and empty texts have none. Rows stay, repeated ones too; columns
    named base, spans or mentions are replaced.
    """
    named = docs.drop("base", "mentions", "spans")
    row = unused(named, "row")
    found = cut(extract(named, text).withColumn(row, F.monotonically_increasing_id()))
    values = cut(likely(found))
    looked = found.select(row, F.explode("mentions").alias("m")).where("m.kind IS NULL").select(row, "m.value", "m.first", "m.last")
    added = looked.join(values, "value").groupBy(row).agg(F.collect_set(F.struct("kind", "first", "last")).alias("added"))
    place = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    both = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind: string, first: int, last: int>>")))
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(F.element_at(place, s["kind"]).alias("place"), s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))
    spans = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last")))
    return found.join(added, row, "left").select(*[c for c in named.columns if c != text], "base", spans.alias("spans"))


def span_string(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def mask(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with every span replaced by its kind in brackets; other columns unchanged.

    Rows are told apart by doc_id and text, null ids too; repeated rows are
    masked alike, null and empty texts stay, an empty table stays empty.
    n_chars, where there is such a column, follows the text.
    """
    key, spans = unused(docs, "key"), unused(docs, "spans")
    keyed = docs.withColumn(key, F.struct(F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text")))
    found = find_personal_data(keyed.select(F.col(key).alias("key"), "text")).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias(spans)).withColumnRenamed("key", key)
    place = keyed.columns.index("text")
    joined = keyed.join(found, key, "left").select(*docs.columns, spans)

    def run(batches):
        for b in batches:
            texts = b.column(place).to_pylist()
            for k, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if spans:
                    out, last = [], 0
                    for s in sorted(spans, key=lambda s: (s["first"], -s["last"])):
                        if s["first"] >= last:
                            out += [texts[k][last : s["first"]], f"[{s['kind'].upper()}]"]
                        last = max(last, s["last"])
                    texts[k] = "".join([*out, texts[k][last:]])
            columns = list(b.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    masked = joined.mapInArrow(run, docs.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; null texts are empty, repeated rows alike."""
    found = find_personal_data(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_string(F.col("base")), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))
