"""Catalogues, charts, training files and hashes from small files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rules as R
from ledgerloom.operators import texts as X
from ledgerloom.sources import files

CATALOGUE = """kategorien:
  wareneingang:
    schlüsselwörter:
      - Gira
      - hager
    standard_konto: "3400"
  buero:
    schlüsselwörter: [papier, "stift rot"]
    standard_konto: "4930"
"""


def test_catalogue_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "rules.yaml").write_text(CATALOGUE, encoding="utf-8")
    rules = files.read_catalogue_yaml(spark, str(tmp_path / "rules.yaml"))
    assert [tuple(r) for r in rules.orderBy("cat_ord", "kw_ord").collect()] == [(0, "wareneingang", 0, "gira", "3400"), (0, "wareneingang", 1, "hager", "3400"), (1, "buero", 0, "papier", "4930"), (1, "buero", 1, "stift rot", "4930")]
    items = spark.createDataFrame([("Papier und Stift rot", None), ("GIRA Rahmen", "Hager GmbH"), (None, None)], "description string, supplier string")
    found = {r.description: r for r in R.classify_by_rules(items, rules).collect()}
    assert found["Papier und Stift rot"].account == "4930" and found["Papier und Stift rot"]["keywords"] == ["papier", "stift rot"]
    assert found["GIRA Rahmen"].category == "wareneingang" and found[None].confidence == 0.2 and found[None].account == "3400"


def test_catalogue_in_plan_and_joined_agree(spark, monkeypatch):
    rules = files.rule_catalogue(spark, [("a", ["rot", "b-c", "kabel"], "3401"), ("b", ["tor", "a.c"], "x"), ("c", ["ka", "bel"], "3403")])
    items = spark.createDataFrame([(t, s) for t in ("Rot Tor", "ab-c kabel", "axc a.c", "", None, "kabel", "karotte") for s in ("Kabel AG", None)], "description string, supplier string")
    rows = lambda: sorted(map(str, R.classify_by_rules(items, rules).collect()))
    one = rows()
    monkeypatch.setattr(R, "MAX_IN_PLAN", 0)
    assert one == rows()


def test_chart(spark, tmp_path):
    (tmp_path / "chart.csv").write_text("account ; category\n 3400;Waren\n;leer\n0480;Anlagen\n3400 ;Material\n", encoding="utf-8")
    chart = files.read_chart(spark, str(tmp_path / "chart.csv"))
    assert sorted(map(tuple, chart.collect())) == [("0480", "Anlagen"), ("3400", "Material")]
    assert {r.category: r.accounts for r in files.accounts_by_category(chart).collect()} == {"Anlagen": ["0480"], "Material": ["3400"]}


def test_chart_in_several_files(spark, tmp_path):
    """The file with the later name counts, not the smaller one, which Spark reads last; nor does a later block give way to an earlier one."""
    head, many = "account;category\n", "".join(f"{k};Rest {k}\n" for k in range(5000, 5400))
    for name, rows in (("part-00000", "3400;alt\n0480;Anlagen\n"), ("part-00001", "3400;neu\n" + many + "5000;zuletzt\n"), ("part-00002", "5001;spät\n")):
        (tmp_path / f"{name}.csv").write_text(head + rows, encoding="utf-8")
    chart = lambda: {r.account: r.category for r in files.read_chart(spark, str(tmp_path)).collect()}
    expected = {str(k): f"Rest {k}" for k in range(5002, 5400)} | {"0480": "Anlagen", "3400": "neu", "5000": "zuletzt", "5001": "spät"}
    assert chart() == expected
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        assert chart() == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_training_files(spark, tmp_path):
    rows = [("a@b.de ruft", [(0, 6, "EMAIL")], {"x": 1.0}), ("nichts", [], {}), ("nur Klasse", [], {"y": 0.5})]
    table = spark.createDataFrame(rows, "text string, entities array<struct<start: int, end: int, label: string>>, cats map<string, double>").withColumn("meta", F.lit("m"))
    entities, cats = str(tmp_path / "entities"), str(tmp_path / "cats")
    files.split_annotations(table, entities, cats)
    files.split_annotations(table.limit(1), entities, cats)
    assert spark.read.json(entities).count() == 2 and spark.read.json(cats).count() == 3
    files.write_examples(table.select("text", F.struct("entities", "cats").alias("annotations")), str(tmp_path / "examples"))
    found = files.read_entity_examples(spark, str(tmp_path / "examples")).collect()
    assert [(r.text, [tuple(e) for e in r.annotations.entities]) for r in found] == [("a@b.de ruft", [(0, 6, "EMAIL")])]
    assert files.read_category_examples(spark, str(tmp_path / "examples")).count() == 2


def test_hashes_and_corrupt_rows(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    found = files.binary_hashes(spark, str(tmp_path / "a.bin")).collect()
    assert [r.content_hash for r in found] == [hashlib.sha256(b"one").hexdigest()]
    (tmp_path / "r.json").write_text('{"a": 1}\n{broken\n', encoding="utf-8")
    good, bad = files.read_results(spark, str(tmp_path / "r.json"), "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 1


def test_corrected_annotations(spark):
    text = "Rahmen von Hager, Schalter von Gira"
    cases = [("Hager", 11, 16, "MARKE"), ("hager", 12, 17, "MARKE"), ("HAGER", 90, 95, "MARKE"), ("ABB", 0, 3, "MARKE"), ("ABB", 0, 3, "ARTIKEL"), ("Gira", 2, 4, "MARKE")]
    d = spark.createDataFrame([(k, text, *c) for k, c in enumerate(cases)], "k int, text string, entity string, a int, z int, label string")
    c = X.corrected_annotation(F.col("text"), F.col("entity"), F.col("a"), F.col("z"), F.col("label"), ["ABB", "GIRA", "HAGER"])
    rows = d.withColumn("c", c).withColumn("fault", X.annotation_fault(F.col("text"), F.col("c")))
    found = [(r.c["text"], r.c.start, r.c.end, r.c.confidence, r.fault) for r in rows.orderBy("k").collect()]
    assert found == [("Hager", 11, 16, 1.0, None), ("hager", 11, 16, 0.95, "mismatch"), ("HAGER", 0, 5, 0.3, "mismatch"), ("GIRA", 31, 35, 0.8, "mismatch"), ("ABB", 0, 3, 0.5, "mismatch"), ("Gira", 31, 35, 0.95, None)]
    assert tuple(rows.agg(*X.correction_counts(F.col("c"))).first()) == (6, 3, 1, 1, 1)
    report = rows.agg(*X.annotation_report(F.col("fault"), F.col("c.confidence"))).first()
    assert report.valid == 2 and report.invalid == 4 and abs(report.mean_confidence - 0.975) < 1e-9


def test_span_scores(spark):
    gold = spark.createDataFrame([(1, 0, 3, "A"), (1, 5, 7, "B"), (2, 0, 1, "A")], "doc_id long, start int, end int, label string")
    predicted = spark.createDataFrame([(1, 0, 3, "A"), (1, 0, 3, "A"), (1, 5, 7, "A")], gold.schema)
    r = X.span_scores(gold, predicted).first()
    assert (r.gold, r.predicted, r.hits) == (3, 2, 1) and abs(r.f1 - 0.4) < 1e-9
    assert X.span_scores(gold.where("false"), predicted.where("false")).first().f1 == 0.0


def test_vote_details(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    n = spark.createDataFrame([(1, 1, "3400", "x", "s1", "e1", 0.5, 1.0), (1, 2, "3410", "y", "s2", "e2", 0.5, 1.0), (1, 3, "3410", "y", "s3", "e3", 0.0, 1.0)], "query_id long, rank int, account string, category string, supplier string, example string, similarity double, confidence double")
    found = {r.query_id: r for r in R.vote_details(q, n).collect()}
    assert (found[1].account, found[1].category, found[1].confidence, found[1].supplier, found[1].examples) == ("3400", "x", 0.5, "s1", ["e1", "e2", "e3"])
    assert (found[2].account, found[2].confidence, found[2].method) == ("3400", 0.1, "fallback")
