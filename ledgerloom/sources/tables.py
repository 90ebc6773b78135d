"""Input tables, and the invoice, feedback and metric roles they play."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The parquet tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


#: Names of the columns that placed() adds.
PLACE = ["_file", "_row"]


def placed(table: DataFrame) -> DataFrame:
    """A parquet table with the place of each row, by which its files' rows come in the order in which they are stored."""
    return table.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def invoice_items(t: Tables, lines: DataFrame | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Line items (or the given lines of them) with description, quantity, price, net amount, rate, supplier and account, and more columns of the lines."""
    p, s = t.part, t.supplier
    return (t.lineitem if lines is None else lines).join(p, F.col("l_partkey") == p.p_partkey).join(s, F.col("l_suppkey") == s.s_suppkey).select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("position"),
        "l_partkey",
        "l_suppkey",
        F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("description"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("net"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_tax").alias("rate"),
        F.col("s_name").alias("supplier"),
        F.concat(F.lit("3"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("account"),
        F.col("l_shipdate").alias("shipped"),
        *more,
    )


#: The same roles in SQL, as common table expressions for the oracle.
ITEMS_SQL = """items AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, l_partkey, l_suppkey,
 p_brand || ' ' || p_type || ' ' || p_name AS description, l_quantity AS quantity, l_extendedprice AS net,
 l_extendedprice / l_quantity AS price, l_tax AS rate, s_name AS supplier,
 '3' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS account, l_shipdate AS shipped
 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""

FEEDBACK_KINDS = {"purchase": "confirmation", "error": "correction", "click": "rejection"}


def feedback(t: Tables) -> DataFrame:
    """Feedback records: events that confirm, correct or reject a classification."""
    kind = F.create_map(*(F.lit(x) for pair in FEEDBACK_KINDS.items() for x in pair))
    e = t.events.where(F.col("event_type").isin(*FEEDBACK_KINDS))
    return e.select(F.col("event_id").alias("feedback_id"), "ts", "user_id", kind[F.col("event_type")].alias("kind"), F.get_json_object("props", "$.k").alias("account"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), F.col("value").alias("price"))


FEEDBACK_SQL = """feedback AS (SELECT event_id AS feedback_id, ts, user_id,
 CASE event_type WHEN 'purchase' THEN 'confirmation' WHEN 'error' THEN 'correction' ELSE 'rejection' END AS kind,
 json_extract_string(props, '$.k') AS account, least(value / 100, 1.0) AS confidence, value AS price
 FROM events WHERE event_type IN ('purchase', 'error', 'click'))"""


def metrics(t: Tables) -> DataFrame:
    """Processing metrics: a row per event."""
    return t.events.select(F.col("event_id").alias("run_id"), "ts", "user_id", (F.col("value") * 10).alias("time_ms"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), (F.col("event_type") == "view").alias("cache_hit"), (F.col("event_type") == "error").alias("error"), F.col("event_type").alias("kind"), (F.col("value") / 10000).alias("cost"))


METRICS_SQL = """metrics AS (SELECT event_id AS run_id, ts, user_id, value * 10 AS time_ms, least(value / 100, 1.0) AS confidence,
 event_type = 'view' AS cache_hit, event_type = 'error' AS error, event_type AS kind, value / 10000 AS cost FROM events)"""
