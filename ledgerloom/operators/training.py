"""Training a category model: a split by hash, a Spark ML pipeline, scores from its confusion matrix, a record and a gate."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Four hexadecimal digits of an id's MD5 digest below this are for training: four fifths.
TRAINING_BELOW = 52_429
#: What a model has to reach, and from where on it is excellent.
LEAST_ACCURACY, LEAST_F1, EXCELLENT_ACCURACY, EXCELLENT_F1 = 0.85, 0.80, 0.95, 0.90


def split_place(key: str) -> str:
    """An SQL expression: 0 to 65535 by the id alone, so a row stays on its side whatever the partitions."""
    digit = lambda k: f"(instr('0123456789abcdef', substr(md5(CAST({key} AS STRING)), {k}, 1)) - 1)"
    return f"{digit(1)} * 4096 + {digit(2)} * 256 + {digit(3)} * 16 + {digit(4)}"


def for_training(key: str) -> Column:
    """Whether a row is for training; rows without key are for validation."""
    return F.coalesce(F.expr(f"{split_place(key)} < {TRAINING_BELOW}"), F.lit(False))


def train_categories(examples: DataFrame, text: str = "text", category: str = "category", features: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """A multinomial model of hashed words; examples without a category are left out, null texts are empty. At least one example is needed."""
    d = examples.where(F.col(category).isNotNull()).withColumn(text, F.coalesce(text, F.lit("")))
    stages = [
        StringIndexer(inputCol=category, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
        LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=rounds, regParam=1e-3),
    ]
    return Pipeline(stages=stages).fit(d)


def predicted(model: PipelineModel, docs: DataFrame, text: str = "text", out: str = "predicted") -> DataFrame:
    """docs with the category that the model finds likeliest."""
    names = F.array(*(F.lit(x) for x in model.stages[0].labels))
    rest = PipelineModel(model.stages[1:]).transform(docs.withColumn(text, F.coalesce(text, F.lit(""))))
    return rest.withColumn(out, F.get(names, F.col("_prediction").cast("int"))).select(*docs.columns, out)


def confusion(df: DataFrame, gold: str = "category", found: str = "predicted") -> DataFrame:
    """(gold, predicted, n): a row for each pair that occurs; rows without gold are left out."""
    return df.where(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("gold"), F.col(found).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(category, support, precision, recall, f1) of each gold category of a confusion matrix."""
    same = F.when(F.col("gold").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    by_gold = matrix.groupBy(F.col("gold").alias("category")).agg(F.sum("n").alias("support"), F.sum(same).alias("hits"))
    by_found = matrix.groupBy(F.col("predicted").alias("category")).agg(F.sum("n").alias("found"))
    d = by_gold.join(by_found, "category", "left").withColumns({"precision": _ratio(F.col("hits"), F.col("found")), "recall": _ratio(F.col("hits"), F.col("support"))})
    return d.select("category", "support", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def model_scores(matrix: DataFrame) -> DataFrame:
    """One row (validation_examples, accuracy, precision, recall, f1): means of the categories; zeros without examples."""
    means = class_scores(matrix).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")))
    same = F.when(F.col("gold").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    every = matrix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("validation_examples"), _ratio(F.sum(same), F.sum("n")).alias("accuracy"))
    return every.join(F.broadcast(means), how="cross")


def gated(scores: DataFrame) -> DataFrame:
    """scores with validation_passed and model_quality (excellent, good, insufficient)."""
    passed = (F.col("accuracy") >= LEAST_ACCURACY) & (F.col("f1") >= LEAST_F1)
    quality = F.when((F.col("accuracy") >= EXCELLENT_ACCURACY) & (F.col("f1") >= EXCELLENT_F1), "excellent").when(passed, "good").otherwise("insufficient")
    return scores.withColumns({"validation_passed": passed, "model_quality": quality})


def train_and_record(examples: DataFrame, key: str, path: str, **settings) -> tuple[PipelineModel, DataFrame]:
    """(model, its record): trains on one side of the split, scores on the other, appends the record to the table at path.

    The record is one row: total, training and validation examples, accuracy,
    precision, recall, f1, the gate, rounds and seconds.
    """
    side = examples.withColumn("_training", for_training(key)).where("category IS NOT NULL")
    began = time.time()
    model = train_categories(side.where("_training").drop("_training"), **settings)
    took = time.time() - began
    scores = gated(model_scores(confusion(predicted(model, side.where("NOT _training").drop("_training")))))
    counts = side.agg(F.count(F.lit(1)).alias("total_examples"), F.count_if("_training").alias("training_examples"))
    record = counts.join(F.broadcast(scores), how="cross").withColumns({"rounds": F.lit(settings.get("rounds", 20)), "training_seconds": F.lit(took)})
    record.coalesce(1).write.mode("append").parquet(path)
    return model, examples.sparkSession.read.schema(record.schema).parquet(path)
