"""Scans and sinks: JSON results, charts of accounts, rule catalogues, training files, stores by key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import stored


def read_results(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """JSON documents of a folder as (valid rows, corrupt rows); nothing raises."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    df = spark.read.schema(StructType([*fields.fields]).add("_corrupt", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = stored(df, "results")  # corrupt records can't be asked for alone while reading
    return df.where("_corrupt IS NULL").drop("_corrupt"), df.where("_corrupt IS NOT NULL").select("_corrupt")


def read_chart(spark: SparkSession, path: str, key: str = "account") -> DataFrame:
    """A chart of accounts from ;-separated text with header, one file or a folder of them in the order of their names; names and keys are trimmed, blank keys go, the last of a key stays."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    # Spark reads larger files and blocks first, so only within a block do the ids tell what is later.
    order = ["_file", "_block", "_line"]
    df = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).toDF(*(c.lstrip("﻿").strip() for c in raw.columns), *order[:2])
    df = df.withColumn(key, F.trim(key)).where(F.col(key) != "").withColumn("_line", F.monotonically_increasing_id())
    last = Window.partitionBy(key).orderBy(*map(F.desc, order))
    return df.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop(*order, "_rank")


def accounts_by_category(chart: DataFrame, key: str = "account", category: str = "category") -> DataFrame:
    return chart.groupBy(category).agg(F.sort_array(F.collect_list(key)).alias("accounts"))


def rule_catalogue(spark: SparkSession, rules: Iterable[tuple[str, list[str], str]]) -> DataFrame:
    """(cat_ord, category, kw_ord, keyword, account) of ordered (category, keywords, account) entries; small by nature."""
    rows = [(i, c, j, k.lower(), a) for i, (c, words, a) in enumerate(rules) for j, k in enumerate(words)]
    return spark.createDataFrame(rows, "cat_ord int, category string, kw_ord int, keyword string, account string")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines {category, account, keywords: [...]} in file order of a field `ord`."""
    df = spark.read.schema("ord int, category string, account string, keywords array<string>").json(path)
    return df.select(F.col("ord").alias("cat_ord"), "category", F.posexplode("keywords").alias("kw_ord", "keyword"), "account").withColumn("keyword", F.lower("keyword"))


def read_catalogue_yaml(spark: SparkSession, path: str, top: str = "kategorien", keywords: str = "schlüsselwörter", account: str = "standard_konto") -> DataFrame:
    """The same from a YAML file whose categories stand below top in order, each with its keywords and account."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    found = (yaml.safe_load(text.value) or {}).get(top) or {} if text else {}
    return rule_catalogue(spark, [(c, list(map(str, e.get(keywords) or [])), str(e.get(account) or "")) for c, e in found.items()])


def write_catalogue_yaml(spark: SparkSession, rules: Iterable[tuple[str, list[str], str]], path: str, top: str = "kategorien", keywords: str = "schlüsselwörter", account: str = "standard_konto") -> None:
    """Writes ordered (category, keywords, account) entries as one YAML file in the folder path."""
    import yaml

    text = yaml.safe_dump({top: {c: {keywords: list(words), account: a} for c, words, a in rules}}, allow_unicode=True, sort_keys=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; blank lines and # comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' AND NOT startswith(name, '#')")


def write_examples(examples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines {text, annotations}."""
    examples.select("text", "annotations").write.mode(mode).json(path)


def read_entity_examples(spark: SparkSession, path: str) -> DataFrame:
    schema = "text string, annotations struct<entities: array<struct<start: int, `end`: int, label: string>>, cats: map<string, double>>"
    return spark.read.schema(schema).json(path).where("size(annotations.entities) > 0")


def read_category_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, annotations struct<cats: map<string, double>>").json(path).where("size(annotations.cats) > 0")


def split_annotations(annotations: DataFrame, entity_path: str, category_path: str) -> None:
    """Appends one annotation table to an entity file and a category file."""
    annotations.where("size(entities) > 0").select("text", "entities", "meta").write.mode("append").json(entity_path)
    annotations.where("size(cats) > 0").select("text", "cats", "meta").write.mode("append").json(category_path)


def latest_per_key(df: DataFrame, key: str | list[str], order: str, tie: str) -> DataFrame:
    """Upsert semantics: of each key the row with the greatest (order, tie)."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_r")).select(*keys, "_r.*")


def guarded_update(base: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(base with the updates of existing keys, updates without a key in base)."""
    changed = updates.join(base.select(key), key, "left_semi")
    return base.join(updates.select(key), key, "left_anti").unionByName(changed), updates.join(base.select(key), key, "left_anti")


def collection_stats(vectors: DataFrame, collection: str, vector: str) -> DataFrame:
    return vectors.groupBy(collection).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dimension"))


def insert_with_summary(df: DataFrame, path: str) -> DataFrame:
    """Appends rows with an id and a vector; returns total, inserted and success rate as one row."""
    checked = df.withColumn("_ok", F.expr("id IS NOT NULL AND size(embedding) > 0"))
    checked.where("_ok").drop("_ok").write.mode("append").parquet(path)
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("inserted")).withColumn("success_rate", F.coalesce(F.try_divide("inserted", "total"), F.lit(0.0)))


def binary_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_hash"))
