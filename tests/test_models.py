"""Encoders, training and strategies."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import encoders as E
from ledgerloom.operators import strategies as S
from ledgerloom.operators import training as T


class Failing:
    name, dimension = "failing", 2

    def load(self):
        return self

    def encode(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return np.array([[len(t), len(texts)] for t in texts], float)


def test_encoder_batches_cleaned_texts_only(spark):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One\n two"), (4, "one two"), (5, "bad"), (6, "abc")]
    d = spark.createDataFrame(rows, "i int, text string").coalesce(1)
    found = {r.i: r.vector for r in E.with_vectors(d, Failing(), batch=1, normalize=False).collect()}
    assert found == {0: [0, 0], 1: [0, 0], 2: [0, 0], 3: [7, 1], 4: [7, 1], 5: [0, 0], 6: [3, 1]}
    together = {r.i: r.vector for r in E.with_vectors(d, Failing(), batch=10, normalize=False).collect()}
    assert together[6] == [0, 0]  # the model failed on the whole batch


def test_hashed_words(spark):
    d = spark.createDataFrame([("b a b",)], "text string")
    v = np.zeros(16)
    for w in "bab":
        v[int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "little") % 16] += 1
    assert np.allclose(E.with_vectors(d, E.HashedWords(16)).first().vector, v / np.linalg.norm(v))


@pytest.fixture(scope="module")
def examples(spark):
    rnd = random.Random(1)
    words = {"a": ["rot", "blau"], "b": ["eins", "zwei"], "c": ["hund", "katze"]}
    rows = [(i, " ".join(rnd.choice(words[c]) for _ in range(6)), c) for i, c in enumerate(rnd.choices("abc", k=240))]
    return spark.createDataFrame([*rows, (900, None, "a"), (901, "rot", None), (None, "rot", "a")], "id long, text string, category string")


def test_split_stays(spark, examples):
    one = {r.id for r in examples.where(T.for_training("id")).collect()}
    two = {r.id for r in examples.repartition(7).orderBy(F.desc("id")).where(T.for_training("id")).collect()}
    assert one == two and 0.7 < len(one) / 243 < 0.9 and None not in one
    assert all((int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16) < T.TRAINING_BELOW) == (i in one) for i in range(240))


def test_training_and_record(spark, examples, tmp_path):
    path = f"file://{tmp_path}/records"
    for _ in range(2):
        model, records = T.train_and_record(examples, "id", path, rounds=10)
    assert records.count() == 2
    r = records.first()
    assert r.total_examples == 242 and r.training_examples + r.validation_examples == 242
    assert r.accuracy > 0.9 and r.validation_passed and r.model_quality in ("excellent", "good")
    assert T.predicted(model, spark.createDataFrame([("hund katze hund",), (None,)], "text string")).first().predicted == "c"


def test_scores_and_gate(spark):
    m = spark.createDataFrame([("a", "a", 8), ("a", "b", 2), ("b", "b", 5), ("c", None, 1)], "gold string, predicted string, n long")
    s = {r.category: (r.support, r.precision, r.recall, round(r.f1, 6)) for r in T.class_scores(m).collect()}
    assert s == {"a": (10, 1.0, 0.8, 0.888889), "b": (5, 5 / 7, 1.0, 0.833333), "c": (1, 0.0, 0.0, 0.0)}
    g = T.gated(T.model_scores(m)).first()
    assert (g.validation_examples, round(g.accuracy, 6), g.validation_passed, g.model_quality) == (16, 0.8125, False, "insufficient")
    none = T.gated(T.model_scores(m.limit(0))).first()
    assert (none.validation_examples, none.accuracy, none.f1, none.model_quality) == (0, 0.0, 0.0, "insufficient")
    gates = spark.createDataFrame([(0.95, 0.9), (0.85, 0.8), (0.99, 0.79)], "accuracy double, f1 double")
    assert [r.model_quality for r in T.gated(gates).collect()] == ["excellent", "good", "insufficient"]


def test_strategies(spark):
    items = spark.range(10).withColumnRenamed("id", "i")
    runs = {"one": lambda d: d.select(F.lit("3400").alias("account"), F.lit(0.5).alias("confidence")), "half": lambda d: d.select(F.when(F.col("i") < 5, "1").alias("account"), F.when(F.col("i") > 7, 2.0).otherwise(0.9).alias("confidence")), "broken": lambda d: d.select("nothing"), "late": lambda d: d.select(F.raise_error(F.lit("x")).cast("string").alias("account"), F.lit(1.0).alias("confidence"))}
    compared = S.compare_strategies(items, runs)
    found = {r.strategy: (r.success, r["items"], r.classified, r.faults) for r in compared.collect()}
    assert found == {"one": (True, 10, 10, 0), "half": (True, 10, 5, 2), "broken": (False, None, None, None), "late": (False, None, None, None)}
    s = S.comparison_summary(compared).first()
    assert (s.tested, s.successful, s.highest_confidence, s.most_classifications) == (4, 2, "half", "one") and s.fastest in ("one", "half")
    with pytest.raises(ValueError, match="two"):
        S.compare_strategies(items, {"one": runs["one"]})
