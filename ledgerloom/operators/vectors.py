"""Text encoding by Spark ML's hashed words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 384


def encode_texts(docs: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """docs with a unit vector of hashed words; blank texts get zeros. For models there are encoders."""
    from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    d = Tokenizer(inputCol="text", outputCol="_w").transform(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    d = d.withColumn("_w", F.filter("_w", lambda w: w != ""))
    d = Normalizer(inputCol="_tf", outputCol="_v").transform(HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dimension).transform(d))
    return d.withColumn("vector", vector_to_array("_v")).drop("_w", "_tf", "_v")
