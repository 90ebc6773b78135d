"""Document quality: header and item completeness, amount consistency, score, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = ("", "Not found")


def present(x: Column) -> Column:
    return F.coalesce(~F.trim(x).isin(*MISSING), F.lit(False))


def header_completeness(*fields: Column) -> Column:
    total = F.lit(0.0)
    for f in fields:
        total = total + present(f).cast("double")
    return total / len(fields)


def amount_consistency(header_total: Column, items_total: Column) -> Column:
    gap = F.try_divide(F.abs(header_total - items_total), header_total)
    return F.when(header_total.isNull() | (header_total <= 0), 0.5).when(items_total.isNull() | (items_total <= 0), 0.3).when(gap <= 0.05, 1.0).when(gap <= 0.15, 0.8).when(gap <= 0.30, 0.5).otherwise(0.2)


def method_consistency(rule: Column, rag: Column) -> Column:
    return F.when(rule & rag, 0.9).when(rule | rag, 0.7).otherwise(0.3)


def supplier_recognition(header: Column, detected: Column) -> Column:
    h, d = F.lower(header), F.lower(detected)
    return F.when(~present(header) & detected.isNull(), 0.2).when(detected.isNull(), 0.6).when(~present(header), 0.7).when(h.contains(d) | d.contains(h), 1.0).otherwise(0.2)


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) the most frequent value of each key, the smallest on ties."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).count()
    first = Window.partitionBy(key).orderBy(F.desc("count"), value)
    return n.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, value)


def document_score(header: Column, confidence: Column, rag: Column, complete: Column, amounts: Column, domain: Column, supplier: Column, items: Column) -> Column:
    """The weighted score of a document, 0 without items."""
    total = 0.25 * header + 0.30 * confidence + 0.15 * rag + 0.10 * complete + 0.10 * amounts + 0.05 * domain + 0.05 * supplier
    return F.when(items == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def vat_totals(items: DataFrame, key: str = "invoice_id", rates: tuple = (0, 7, 19)) -> DataFrame:
    """Net and VAT per rate and in all, per invoice; items(key, net decimal, rate int)."""
    net = [F.coalesce(F.sum(F.when(F.col("rate") == r, F.col("net"))), F.lit(0)).alias(f"net_{r}") for r in rates]
    vat = [F.coalesce(F.sum(F.when(F.col("rate") == r, F.col("net") * r / 100)), F.lit(0)).alias(f"vat_{r}") for r in rates]
    return items.groupBy(key).agg(*net, *vat, F.sum("net").alias("net"), F.sum(F.col("net") * F.col("rate") / 100).alias("vat"))
