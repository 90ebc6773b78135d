"""Scans of whole texts for many literals at once, and for ordered patterns with their places.

Literals go into an Aho-Corasick automaton, built once per Python worker, which
finds all of them in one pass over a text whatever their number. A pattern names
literals of which each of its matches has one; only texts with one of them are
matched at all, by the JVM's expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .texts import pattern_spans

#: Literals of one automaton at most: some 100 MB in each worker.
MAX_LITERALS = 1_000_000

_AUTOMATA: dict = {}


def _automaton(shared):
    """The automaton of a broadcast list of literals, kept for the worker's next tasks."""
    import ahocorasick

    if shared.id not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for k, literal in enumerate(shared.value):
            made.add_word(literal, (k, len(literal)))
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[shared.id] = made
    return _AUTOMATA[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _check(literals: list[str]) -> list[str]:
    if len(literals) > MAX_LITERALS:
        raise ValueError(f"more than {MAX_LITERALS} literals")
    if len(set(literals)) != len(literals) or "" in literals:
        raise ValueError("literals are distinct and not empty")
    return literals


def contained(df: DataFrame, text: str, literals: list[str], out: str = "found") -> DataFrame:
    """df with out, the numbers of the literals that the column text contains, rising; none for null."""
    shared = _Shared(df.sparkSession.sparkContext.broadcast(_check(literals)))
    place, names, some = df.columns.index(text), [*df.columns, out], bool(literals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _automaton(shared) if some else None
        for b in batches:
            hits = [sorted({k for _, (k, _) in held.iter(t)}) if held and t else [] for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.int32()))], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, ArrayType(IntegerType())))


def occurrences(df: DataFrame, key: str, text: str, literals: list[str]) -> DataFrame:
    """(key, literal, start, line): every place of every literal, overlapping ones too; start from 0 and line from 1."""
    shared = _Shared(df.sparkSession.sparkContext.broadcast(_check(literals)))
    names, some = [key, "literal", "start", "line"], bool(literals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _automaton(shared) if some else None
        for b in batches:
            at, found, starts, lines = [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                line = seen = 0
                for end, (k, n) in sorted(held.iter(t), key=lambda x: x[0] - x[1][1]) if held and t else ():
                    start = end - n + 1
                    line += t.count("\n", seen, start)
                    seen = start
                    at.append(row)
                    found.append(shared.value[k])
                    starts.append(start)
                    lines.append(line + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(lines, pa.int32())], names=names)

    return df.select(key, text).mapInArrow(run, StructType([df.schema[key]]).add("literal", "string").add("start", "integer").add("line", "integer"))


class Pattern(NamedTuple):
    """A pattern to scan for; literals are in lower case, none mean that every text is matched."""

    name: str
    severity: str
    regex: str
    literals: tuple[str, ...] = ()


def pattern_findings(df: DataFrame, key: str, text: str, patterns: list[Pattern]) -> DataFrame:
    """(key, pattern, severity, line, start, match, number): every match of every pattern in whole texts, lines from 1.

    number is the pattern's place in the list; null texts have no findings. A
    pattern's literals are looked for in the lower-cased text.
    """
    literals = sorted({x for p in patterns for x in p.literals})
    d = contained(df.select(key, text, F.lower(text).alias("_low")), "_low", literals, "_literals").drop("_low")
    of = {x: k for k, x in enumerate(literals)}

    def spans(n: int, p: Pattern):
        may = F.arrays_overlap("_literals", F.array(*(F.lit(of[x]) for x in p.literals))) if p.literals else F.lit(True)
        found = F.transform(pattern_spans(F.col(text), p.regex), lambda s: F.struct(F.lit(n).alias("number"), F.lit(p.name).alias("pattern"), F.lit(p.severity).alias("severity"), s["start"].alias("start"), s["value"].alias("match")))
        return F.when(may & F.col(text).isNotNull(), found).otherwise(F.slice(found, 1, 0))

    d = d.select(key, text, F.explode(F.concat(*(spans(n, p) for n, p in enumerate(patterns)))).alias("_f"))
    line = F.length(F.regexp_replace(F.substring(F.col(text), F.lit(1), F.col("_f.start")), "[^\n]", "")) + 1
    return d.select(key, "_f.pattern", "_f.severity", line.alias("line"), "_f.start", "_f.match", "_f.number")


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: findings in all, and those of high, medium and low severity."""
    return findings.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")))
