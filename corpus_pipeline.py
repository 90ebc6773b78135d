"""The corpus pipeline: stages over documents, each written and read again.

A stage takes (spark, docs, sf_dir) and works on every row its predecessor kept.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import as_array, encode, word_tokenizer
from ledgerloom.llm.common import scratch, table, unused
from ledgerloom.llm.language_id import LEAST_SCORE, UNDETERMINED, predict, train
from ledgerloom.llm.mixing import take_mixture
from ledgerloom.llm.ngram_join import keep_one_per_class
from ledgerloom.llm.pii import mask


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the others, without a letter or below LEAST_SCORE, go.

    The model learns from the labelled rows of its own input. A missing lang is
    filled with the prediction. Null and empty texts are undetermined and go;
    repeated rows stay repeated; an empty table stays empty.
    """
    lang, score = unused(docs, "found_lang"), unused(docs, "found_score")
    found = predict(docs, train(docs), lang, score)
    kept = found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id.

    Null and empty texts are classes of their own and stay, as do rows without
    doc_id and rows that repeat a kept doc_id; an empty table stays empty.
    """
    return keep_one_per_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind.

    Null and empty texts stay as they are, repeated rows are masked alike; an
    empty table stays empty.
    """
    return mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it.

    Documents without words are never taken, a null source is the last one;
    rows that share a doc_id share its copies; an empty table stays empty.
    """
    return take_mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids) of every row; null and empty texts have no ids, repeated rows equal ones."""
    ids = encode(docs.select("doc_id", "lang", "source", "text"), word_tokenizer()).drop("text")
    return as_array(ids).select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("language", language), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("encoding", encoding)]

#: SQL cannot express the language model, the pattern graph, the tilts or the merges; tests/llm compares run() with a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
