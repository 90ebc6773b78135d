"""Scans, tables by tiers, large catalogues and in-row counts against plain Python."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rules as R
from ledgerloom.operators import scan as S
from ledgerloom.operators import tables as T
from ledgerloom.operators import texts as X
from ledgerloom.sources.files import rule_catalogue

TEXTS = [None, "", "abc", "Größe abab\nabc x=1\n\nab", "token = 'a'\nnothing\nTOKEN = 'bb' eval (x)\n", "eval(", "a" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_literals(spark, docs):
    literals = ["ab", "abc", "b", "ß", "zzz"]
    found = {r.doc_id: list(r.found) for r in S.contained(docs, "text", literals).collect()}
    assert found == {i: [k for k, x in enumerate(literals) if x in (t or "")] for i, t in enumerate(TEXTS)}
    places = sorted(map(tuple, S.occurrences(docs, "doc_id", "text", literals).collect()))
    expected = [(i, x, m.start(), t[: m.start()].count("\n") + 1) for i, t in enumerate(TEXTS) if t for x in literals for m in re.finditer(f"(?={x})", t)]
    assert places == sorted(expected)
    assert S.contained(docs, "text", []).where("size(found) > 0").count() == 0
    with pytest.raises(ValueError, match="distinct"):
        S.contained(docs, "text", ["a", "a"])


def test_pattern_findings(docs):
    patterns = [S.Pattern("credentials", "high", r"(?i)token\s*=\s*'[^']+'", ("token",)), S.Pattern("eval", "high", r"eval\s*\(", ("eval",)), S.Pattern("digit", "low", "[0-9]")]
    found = sorted(map(tuple, S.pattern_findings(docs, "doc_id", "text", patterns).collect()))
    expected = [(i, p.name, p.severity, t[: m.start()].count("\n") + 1, m.start(), m.group(), n) for i, t in enumerate(TEXTS) if t for n, p in enumerate(patterns) for m in re.finditer(p.regex, t)]
    assert found == sorted(expected) and len(found) == 5
    assert tuple(S.severity_counts(S.pattern_findings(docs, "doc_id", "text", patterns)).first()) == (5, 4, 0, 1)


def test_spans_of_many_matches(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["1", "22", "ab", "ü ", "\n"]) for _ in range(n)) for n in (0, 1, 2, 7, 50, 3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.pattern_spans(F.col("t"), "[0-9]+").alias("s"))
    for r in d.collect():
        assert [tuple(s) for s in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", texts[r.i])]


def test_most_frequent(spark):
    rnd = random.Random(4)
    lists = [[rnd.choice("abcde") for _ in range(n)] for n in (0, 1, 2, 9, 200)]
    d = spark.createDataFrame(list(enumerate(lists)), "i int, x array<string>").select("i", X.most_frequent(F.col("x"), 3).alias("b"))
    for r in d.collect():
        assert [(b["item"], -b["neg"]) for b in r.b] == collections.Counter(lists[r.i]).most_common(3)


BAR_TEXT = "intro\n| Pos | Name |\n|:--|--:|\n| 1 | bolt | \n\n2 | nut\n| |\nlast | one\nend\na | b"


def test_table_tiers(spark):
    rows = [(0, BAR_TEXT), (1, "x" * 90 + " 12 bolts 5,00 and 7 nuts 1,50"), (2, "12 bolts 5,00 and 7 nuts 1,50"), (3, None), (4, ""), (5, "y" * 100 + " 12 bolts 5,00"), (6, "z" * 99 + "\nk: 1\nl: 2\n")]
    patterns = [T.TablePattern(r"([0-9]+) ([a-z]+) ([0-9]+,[0-9]{2})", 3, ("menge", "name", "preis")), T.TablePattern(r"([a-z]): ([0-9])", 2)]
    text = F.col("t")
    d = spark.createDataFrame(rows, "i int, t string").select("i", T.first_tier([T.bar_tables(text), T.pattern_tables(text, patterns)]).alias("tables"))
    found = {r.i: [(t.method, t.table_index, t.headers, t.rows, t.confidence) for t in r.tables] for r in d.collect()}
    assert found == {
        0: [("bars", 0, ["Pos", "Name"], [["1", "bolt"]], 0.9), ("bars", 1, ["2", "nut"], [["last", "one"]], 0.9)],
        1: [("pattern", 0, ["menge", "name", "preis"], [["12", "bolts", "5,00"], ["7", "nuts", "1,50"]], 0.6)],
        2: [], 3: [], 4: [], 5: [],
        6: [("pattern", 1, ["column_1", "column_2"], [["k", "1"], ["l", "2"]], 0.6)],
    }
    one = d.where("i = 1").select(F.explode("tables").alias("x")).select(*(c.alias(k) for k, c in T.described(F.col("x"), [("quantity", ["menge"]), ("price", ["preis"])]).items())).first()
    assert one.normalized_headers == ["quantity", "column_1", "price"] and (one.row_count, one.column_count) == (2, 3)


def test_extraction_score(spark):
    fields = F.create_map(F.lit("invoice_number"), F.lit("7"), F.lit("total_gross"), F.lit("1"))
    d = spark.createDataFrame([("x" * 2500, 1), (None, 0)], "t string, p int")
    found = [round(r[0], 9) for r in d.select(T.extraction_score(F.col("t"), F.array(F.lit(1)), F.when(F.col("p") > 0, fields), F.col("p"))).collect()]
    assert found == [round(0.2 + 0.2 / 3 + 0.15 + 0.1, 9), round(0.2 / 3, 9)]


@pytest.mark.parametrize("extra", [0, 400])
def test_keywords_are_literal(spark, extra):
    """Also by way of the automaton, which a catalogue too large for the plan takes."""
    entries = [("a", ["(neu", "u.v", "c++"], "3401"), ("b", ["rot"], "3402"), ("c", [f"nie{k}x" for k in range(extra)], "3403")]
    rules = rule_catalogue(spark, entries)
    items = spark.createDataFrame([("kabel (neu) uxv", "s"), ("u.v", "u.v gmbh"), ("c++x", None), ("rot", "s"), ("roter", "s"), ("nichts", "s"), (None, "s"), ("rot", "s")], "description string, supplier string")
    found = {(r.description, r.category, round(r.confidence, 6), tuple(r.keywords)) for r in R.classify_by_rules(items, rules).collect()}
    base = lambda n, more=0.0: round(min(0.8, 0.3 + 0.05 * (1 + 0.1 * n + more)) + 0.03, 6)
    assert found == {("kabel (neu) uxv", "a", base(4, 0.5), ("(neu",)), ("u.v", "a", base(3, 2.5), ("u.v",)), ("c++x", "a", base(3), ("c++",)), ("rot", "b", base(3, 0.5), ("rot",)), ("roter", "b", base(3), ("rot",)), ("nichts", "default", 0.2, ()), (None, "default", 0.2, ())}
    simple = {r.description: (r.account, round(r.confidence, 6)) for r in R.classify_by_rules_simple(items, rules, ["c++"]).collect()}
    assert simple["c++x"] == ("3401", round(min(0.9, 0.3 + 0.13) + 0.05 + 0.15, 6)) and simple["rot"] == ("3402", round(0.43 + 0.05, 6)) and simple["nichts"] == (None, 0.2)
