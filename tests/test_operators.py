"""Known values and edge cases of operators."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import quality as Q
from ledgerloom.operators import rules as R
from ledgerloom.operators import texts as X
from ledgerloom.sources.files import rule_catalogue


@pytest.mark.parametrize(("text", "confidence"), [("kabel hager weiss", 0.43), ("xabbx", 0.395), ("nichts", 0.2), ("gira", 0.425), ("siemens", 0.44)])
def test_rule_confidence(spark, text, confidence):
    rules = rule_catalogue(spark, [("elektro", ["hager", "abb", "gira", "siemens"], "3400")])
    items = spark.createDataFrame([(text, None)], "description string, supplier string")
    r = R.classify_by_rules(items, rules, "elektro").first()
    assert round(r.confidence, 6) == confidence and r.account == "3400" and r.category == "elektro"


def test_first_category_wins_ties(spark):
    rules = rule_catalogue(spark, [("a", ["rot"], "3401"), ("b", ["tor"], "3402")])
    items = spark.createDataFrame([("rot tor", "x")], "description string, supplier string")
    assert R.classify_by_rules(items, rules).first().category == "a"


def test_document_score(spark):
    r = spark.range(1).select(Q.document_score(F.lit(0.0), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.5), (F.lit(0.0) + 1.0 + 0.3) / 3, F.lit(0.2), F.lit(10)).alias("s")).first()
    assert round(r.s, 7) == 0.2316667


def test_scalars(spark):
    r = spark.range(1).select(S.parse_amount(F.lit("1.234,56 €")).alias("a"), S.parse_amount(F.lit("x")).alias("b"), S.format_currency(F.lit(1234.5)).alias("c"), S.valid_account(F.lit("0480")).alias("d"), S.valid_account(F.lit("3400")).alias("e"), S.quality_band(F.lit(0.2317)).alias("f"), S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("g")).first()
    assert tuple(r) == (1234.56, None, "1.234,50 EUR", False, True, "poor", 0.0)


def test_spans_and_overlaps(spark):
    d = spark.createDataFrame([("Größe 12 äöü 345 x",), ("",), (None,)], "t string")
    rows = [r.s for r in d.select(X.pattern_spans(F.col("t"), "[0-9]+").alias("s")).collect()]
    assert [(s.start, s.end, s.value) for s in rows[0]] == [(6, 8, "12"), (13, 16, "345")]
    assert not rows[1]
    kept = spark.sql("SELECT array(named_struct('start', 0, 'end', 3), named_struct('start', 2, 'end', 8), named_struct('start', 8, 'end', 9)) AS s").select(X.without_overlaps(F.col("s")).alias("k")).first().k
    assert [(s.start, s.end) for s in kept] == [(2, 8), (8, 9)]


def test_catalogue_order_does_not_depend_on_rows(spark):
    entries = [("a", ["x", "yy"], "3401"), ("b", ["zzz"], "3402")]
    items = spark.createDataFrame([(t, "s") for t in ("x zzz", "yy", "zzz", "q")], "description string, supplier string")
    rules = rule_catalogue(spark, entries)
    one = {r.description: r.category for r in R.classify_by_rules(items, rules).collect()}
    two = {r.description: r.category for r in R.classify_by_rules(items.orderBy(F.desc("description")), rules.orderBy(F.desc("keyword"))).collect()}
    assert one == two


def test_feedback_boost_price_bounds(spark):
    items = spark.createDataFrame([(k, "s", p, "red bolt", "1", 0.5) for k, p in enumerate([None, 0.0, 0.0005, 79.9, 80.0, 119.9, 120.0, 120.1, 1e9])], "item_id int, supplier string, price double, description string, account string, confidence double")
    patterns = spark.createDataFrame([("s", "1", "Bolt", 2, 0.1, 80.0, 120.0), ("s", "2", "red", 1, 0.1, 0.0, 0.001), ("t", "1", "bolt", 9, 0.3, 0.0, 1e12)], "supplier string, account string, description string, n int, boost double, price_min double, price_max double")
    found = {r.item_id: round(r.confidence, 6) for r in R.feedback_boost(items, patterns).collect()}
    assert found == {0: 0.5, 1: 0.49, 2: 0.49, 3: 0.5, 4: 0.52, 5: 0.52, 6: 0.52, 7: 0.5, 8: 0.5}


def test_feedback_boost_takes_the_top_patterns(spark):
    """Ties go to the account, then the text."""
    patterns = spark.createDataFrame([("s", a, d, n, 0.1, 5.0, 6.0) for a, d, n in [("1", "x", 4), ("2", "x", 4), ("1", "y", 9), ("3", "x", 1), ("1", "q", 50), ("2", "y", 4)]], "supplier string, account string, description string, n int, boost double, price_min double, price_max double")
    items = spark.createDataFrame([(0, "s", 5.5, "x y", "1", 0.5), (1, "s", 5.5, "X", "2", 0.5), (2, "t", 5.5, "x y", "1", 0.5), (3, "s", 5.5, "zzz", "1", 0.5)], "item_id int, supplier string, price double, description string, account string, confidence double")
    found = {r.item_id: round(r.confidence, 6) for r in R.feedback_boost(items, patterns).collect()}
    # Item 0: y of 1 (+.09), x of 1 (+.04), x of 2 (-.01); item 1: x of 1 (-.01), x of 2 (+.04), x of 3 (-.01).
    assert found == {0: 0.62, 1: 0.52, 2: 0.5, 3: 0.5}
