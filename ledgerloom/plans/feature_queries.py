"""Queries of feature plug-ins, matched fields, expense types and business features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.plugins import FeaturePipeline, process_documents
from ..operators import texts as X
from ..sources.tables import ITEMS_SQL, PLACE, invoice_items, placed
from .registry import query


@query("SELECT doc_id, length(text) AS text_chars, contains(text, '@') AS mail_has_at, upper(source) AS origin_name, 3 AS n_features, 3 AS n_producers FROM documents")
def feature_pipeline(t):
    p = FeaturePipeline()
    p.add("text", lambda df: {"chars": F.length("text")}).add("mail", lambda df: {"has_at": df.text.contains("@")}).add("origin", lambda df: {"name": F.upper("source")})
    p.add("broken", lambda df: {"x": df.no_such_column}).add("off", lambda df: {"x": F.lit(1)}).enable("off", False)
    return p.extract(t.documents, ["doc_id"])


def _first_words(batch):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([(x or "").split(" ", 1)[0] for x in batch.column(1).to_pylist()])], names=["doc_id", "first_word"])


@query("SELECT doc_id, split_part(text, ' ', 1) AS first_word FROM documents")
def plugged_strategy(t):
    return process_documents(t.documents.select("doc_id", "text"), _first_words, "doc_id long, first_word string")


@query("SELECT a.p_partkey, list_has_any(string_split(a.p_name, ' '), ['bolt', 'ring', 'gear']) AS by_name, list_has_any(string_split(a.p_type, ' '), ['PROMO', 'SMALL']) AS by_type FROM part a")
def matched_fields(t):
    return t.part.select("p_partkey", F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("bolt"), F.lit("ring"), F.lit("gear"))).alias("by_name"), F.arrays_overlap(F.split("p_type", " "), F.array(F.lit("PROMO"), F.lit("SMALL"))).alias("by_type"))


@query("WITH m AS (SELECT p_partkey, p_type, CASE WHEN contains(p_name, 'bolt') THEN '3400' WHEN contains(p_name, 'gear') THEN '3410' END AS rule FROM part), n AS (SELECT p_type, arg_max(a, (c, a)) AS mode FROM (SELECT p_type, CASE WHEN p_size % 2 = 0 THEN '3400' ELSE '3410' END AS a, count(*) AS c FROM part WHERE p_size < 25 GROUP BY 1, 2) GROUP BY 1) SELECT p_partkey, coalesce(rule, mode, '6300') AS account, CASE WHEN rule IS NOT NULL AND rule = mode THEN 0.9 WHEN rule IS NOT NULL THEN 0.7 WHEN mode IS NOT NULL THEN 0.6 ELSE 0.5 END AS confidence FROM m LEFT JOIN n USING (p_type)")
def expense_types(t):
    rule = F.when(F.col("p_name").contains("bolt"), "3400").when(F.col("p_name").contains("gear"), "3410")
    n = t.part.where("p_size < 25").groupBy("p_type", F.when(F.col("p_size") % 2 == 0, "3400").otherwise("3410").alias("a")).agg(F.count(F.lit(1)).alias("c"))
    mode = n.groupBy("p_type").agg(F.max_by("a", F.struct("c", "a")).alias("mode"))
    d = t.part.select("p_partkey", "p_type", rule.alias("rule")).join(mode, "p_type", "left")
    return d.select("p_partkey", F.coalesce("rule", "mode", F.lit("6300")).alias("account"), F.when(F.col("rule") == F.col("mode"), 0.9).when(F.col("rule").isNotNull(), 0.7).when(F.col("mode").isNotNull(), 0.6).otherwise(0.5).alias("confidence"))


@query("SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 'trade' WHEN contains(lower(c_mktsegment), 'mach') THEN 'maker' ELSE 'other' END AS kind, CASE WHEN regexp_matches(lower(c_mktsegment), 'auto|mach') THEN 1.0 ELSE 0.5 END AS trust FROM customer")
def supplier_features(t):
    s = F.lower("c_mktsegment")
    return t.customer.select("c_custkey", F.when(s.contains("auto"), "trade").when(s.contains("mach"), "maker").otherwise("other").alias("kind"), F.when(s.rlike("auto|mach"), 1.0).otherwise(0.5).alias("trust"))


@query(f"WITH {ITEMS_SQL} SELECT invoice_id, array_to_string(list_sort(list(DISTINCT CAST(round(rate * 100) AS INT))), ',') AS rates, round(sum(net * rate) / sum(net), 9) AS vat_ratio, sum(net * rate) / sum(net) BETWEEN 0.02 AND 0.06 AS plausible FROM items GROUP BY 1")
def tax_features(t):
    """VAT rates and ratio of each invoice.

    An invoice of one rate lies on a bound of what is plausible, where the last
    bit of a sum decides, so lines are added in the order in which they are
    stored: results don't depend on splits, and agree with the SQL run in order.
    """
    so_far = Window.partitionBy("invoice_id").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    i = invoice_items(t, placed(t.lineitem), PLACE).select("invoice_id", *PLACE, "net", "rate")
    vat, net = F.sum(F.col("net") * F.col("rate")).over(so_far), F.sum("net").over(so_far)
    i = i.select("invoice_id", "rate", vat.alias("vat"), net.alias("net"), F.row_number().over(so_far).alias("n"))
    ratio = F.try_divide(F.max_by("vat", "n"), F.max_by("net", "n"))
    return i.groupBy("invoice_id").agg(F.array_join(F.sort_array(F.collect_set(F.round(F.col("rate") * 100).cast("int"))), ",").alias("rates"), F.round(ratio, 9).alias("vat_ratio"), ratio.between(0.02, 0.06).alias("plausible"))


@query(r"SELECT doc_id, regexp_matches(lower(text), 'token|license|copyright') AS legal, regexp_matches(lower(text), '\b(the|and)\b') AS english, regexp_matches(text, '[0-9]{4}') AS numbered FROM documents")
def business_flags(t):
    low = F.lower("text")
    return t.documents.select("doc_id", low.rlike("token|license|copyright").alias("legal"), low.rlike(r"\b(the|and)\b").alias("english"), F.col("text").rlike("[0-9]{4}").alias("numbered"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w IN ('the', 'der', 'que', 'de'))) AS stopwords, len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, ' '))) AS indented, round((length(text) - length(replace(text, ' ', ''))) / greatest(length(text), 1), 9) AS blank_ratio FROM documents")
def text_consistency(t):
    return t.documents.select("doc_id", F.size(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w.isin("the", "der", "que", "de"))).alias("stopwords"), F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith(" "))).alias("indented"), F.round(F.regexp_count("text", F.lit(" ")) / F.greatest(F.length("text"), F.lit(1)), 9).alias("blank_ratio"))


@query(r"SELECT doc_id, round(coalesce(list_avg(list_transform(w, lambda x: length(x))), 0) / 10, 9) AS word_difficulty, len(r) > 3 AS many_sections, round((CASE WHEN contains(text, '@') THEN 1 ELSE 0 END + CASE WHEN contains(text, '|') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'token') THEN 1 ELSE 0 END) / 3.0, 9) AS key_share FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS r FROM documents)")
def structure_and_difficulty(t):
    keys = sum((F.col("text").contains(k).cast("int") for k in ("@", "|", "token")), F.lit(0))
    return t.documents.select("doc_id", F.round(X.mean_length(X.words(F.col("text"))) / 10, 9).alias("word_difficulty"), (F.size(F.split("text", "\n")) > 3).alias("many_sections"), F.round(keys / 3, 9).alias("key_share"))


@query("SELECT p_partkey, instr('Brand ' || p_brand || ' Type ' || p_type, p_brand) - 1 AS brand_start, instr('Brand ' || p_brand || ' Type ' || p_type, p_type) - 1 AS type_start FROM part")
def field_label_spans(t):
    text = F.concat(F.lit("Brand "), "p_brand", F.lit(" Type "), "p_type")
    return t.part.select("p_partkey", (F.instr(text, F.col("p_brand")) - 1).alias("brand_start"), (F.instr(text, F.col("p_type")) - 1).alias("type_start"))
