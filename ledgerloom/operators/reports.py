"""Reports on invoices, runs and feature extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plugins import FeaturePipeline

#: Header fields that have to be there; below which confidence a position is doubtful, and from which share on that is grave.
HEADER_FIELDS = ("supplier_name", "invoice_number", "date", "total_amount")
LOW_CONFIDENCE, GRAVE_SHARE = 0.5, 0.3


def header_flags(header: DataFrame) -> dict[str, Column]:
    """Of each header field whether it has more than blanks."""
    return {f: F.coalesce(F.trim(header[f].cast("string")) != "", F.lit(False)) for f in HEADER_FIELDS}


def invoice_issues(header: DataFrame, items: DataFrame) -> DataFrame:
    """(invoice_id, type, severity, n, description) of header(invoice_id, the four fields) and items(invoice_id, account, confidence).

    One row for each kind of issue that an invoice has: missing header fields,
    doubtful positions (grave beyond a share of them), positions without an
    account. A missing confidence is 0. Invoices without items have header
    issues only.
    """
    doubtful, bare = F.coalesce("confidence", F.lit(0.0)) < LOW_CONFIDENCE, F.coalesce(F.trim("account"), F.lit("")) == ""
    per = items.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("positions"), F.count_if(doubtful).alias("low"), F.count_if(bare).alias("bare"))
    missing = F.array_compact(F.array(*(F.when(~c, F.lit(f)) for f, c in header_flags(header).items())))
    d = header.select("invoice_id", missing.alias("missing")).join(per, "invoice_id", "left")

    def issue(when: Column, kind: str, severity: Column, n: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), n.cast("long").alias("n"), text.alias("description")))

    issues = F.array_compact(
        F.array(
            issue(F.size("missing") > 0, "missing_header_data", F.lit("medium"), F.size("missing"), F.array_join("missing", ", ")),
            issue(F.col("low") > 0, "low_confidence_classifications", F.when(F.col("low") > F.col("positions") * GRAVE_SHARE, "high").otherwise("medium"), F.col("low"), F.concat(F.col("low").cast("string"), F.lit(" positions of low confidence"))),
            issue(F.col("bare") > 0, "missing_accounts", F.lit("high"), F.col("bare"), F.concat(F.col("bare").cast("string"), F.lit(" positions without account"))),
        )
    )
    return d.select("invoice_id", F.explode(issues).alias("i")).select("invoice_id", "i.*")


def cost_efficiency(runs: DataFrame, by: str) -> DataFrame:
    """(by, items, items_per_second, cost_per_item, confidence_per_cost) of runs(by, time_ms, cost, confidence), to four digits; 0 where time or cost is none."""
    ratio = lambda a, b: F.round(F.coalesce(F.when(b > 0, F.try_divide(a, b)), F.lit(0.0)), 4)
    g = runs.groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.avg("time_ms").alias("_ms"), F.sum("cost").alias("_cost"), F.avg("confidence").alias("_confidence"))
    return g.select(by, "items", ratio(F.lit(1000.0), F.col("_ms")).alias("items_per_second"), ratio(F.col("_cost"), F.col("items")).alias("cost_per_item"), ratio(F.col("_confidence"), F.col("_cost")).alias("confidence_per_cost"))


def feature_report(df: DataFrame, pipeline: FeaturePipeline) -> tuple[DataFrame, DataFrame]:
    """(per producer, in all) of a pipeline's run over df, in one pass each; a feature counts where it is not null.

    Per producer: documents in which it gave a feature, features, features per
    such document, share of documents; a producer that can't be built has
    zeros. In all: documents, those with features, their share, the least, most
    and mean number of features of these, and the features that occur at all.
    """
    made = pipeline.columns(df)
    of = {name: [c for k, c in made.items() if k.startswith(f"{name}_")] for name in pipeline.producers if name not in pipeline.disabled}
    given = lambda columns: sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    per = F.array(*(F.struct(F.lit(name).alias("producer"), given(columns).alias("k")) for name, columns in of.items()))
    producers = df.select(F.explode(per).alias("p")).groupBy("p.producer").agg(F.count_if(F.col("p.k") > 0).alias("success_count"), F.sum("p.k").alias("total_features"), F.count(F.lit(1)).alias("_n"))
    producers = producers.select("producer", "success_count", "total_features", F.coalesce(F.try_divide("total_features", "success_count"), F.lit(0.0)).alias("avg_features"), (F.col("success_count") / F.col("_n")).alias("success_rate"))
    every = df.select(given(list(made.values())).alias("k"), *(c.isNotNull().alias(f"h_{i}") for i, c in enumerate(made.values())))
    some = F.when(F.col("k") > 0, F.col("k"))
    unique = sum((F.coalesce(F.max(F.col(f"h_{i}").cast("int")), F.lit(0)) for i in range(len(made))), F.lit(0))
    totals = every.agg(F.count(F.lit(1)).alias("documents"), F.count(some).alias("successful"), F.min(some).alias("least"), F.max(some).alias("most"), F.avg(some).alias("mean"), unique.alias("unique_features"))
    return producers, totals.withColumn("success_rate", F.coalesce(F.try_divide("successful", "documents"), F.lit(0.0)))
