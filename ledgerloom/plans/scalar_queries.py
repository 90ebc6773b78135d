"""Queries of scans, upserts, scalar classification and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.files import collection_stats, guarded_update, latest_per_key
from ..sources.tables import FEEDBACK_SQL, ITEMS_SQL, METRICS_SQL, feedback, invoice_items, metrics
from .registry import query


@query("SELECT '3' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS account, count(*) AS n, min(p_type) AS first_type FROM part GROUP BY 1")
def account_dimension(t):
    p = t.part.withColumn("account", F.concat(F.lit("3"), F.lpad(F.col("p_size").cast("string"), 3, "0")))
    return p.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.min("p_type").alias("first_type"))


@query("SELECT p_type AS category, array_to_string(list_sort(list(DISTINCT '3' || lpad(CAST(p_size AS VARCHAR), 3, '0'))), ',') AS accounts FROM part GROUP BY 1")
def accounts_by_category(t):
    p = t.part.select(F.col("p_type").alias("category"), F.concat(F.lit("3"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("account")).distinct()
    return p.groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("account")), ",").alias("accounts"))


@query("SELECT o_orderkey AS invoice_id, count(l_orderkey) AS items, round(coalesce(sum(l_extendedprice), 0), 2) AS gross, sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus) AS content_hash FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def audit_rows(t):
    items = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.sum("l_extendedprice").alias("gross"))
    o = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("invoice_id"), F.coalesce("items", F.lit(0)).alias("items"), F.round(F.coalesce("gross", F.lit(0.0)), 2).alias("gross"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("content_hash"))


@query("SELECT event_id, 'failed: ' || event_type AS message, 0.0 AS confidence, 'poor' AS quality, TRUE AS error_occurred FROM events WHERE event_type = 'error'")
def error_metrics(t):
    return t.events.where("event_type = 'error'").select("event_id", F.concat(F.lit("failed: "), "event_type").alias("message"), F.lit(0.0).alias("confidence"), F.lit("poor").alias("quality"), F.lit(True).alias("error_occurred"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(f"WITH {FEEDBACK_SQL} SELECT feedback_id, user_id, kind, account, round(confidence, 6) AS confidence FROM feedback")
def feedback_log(t):
    return feedback(t).select("feedback_id", "user_id", "kind", "account", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {METRICS_SQL} SELECT run_id, round(time_ms, 4) AS time_ms, round(confidence, 6) AS confidence, cache_hit, error, kind FROM metrics")
def metric_log(t):
    return metrics(t).select("run_id", F.round("time_ms", 4).alias("time_ms"), F.round("confidence", 6).alias("confidence"), "cache_hit", "error", "kind")


@query(f"WITH {METRICS_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, kind AS service, round(sum(cost), 6) AS cost, count(*) AS n FROM metrics GROUP BY 1, 2")
def cost_log(t):
    return metrics(t).groupBy(F.to_date("ts").cast("string").alias("day"), F.col("kind").alias("service")).agg(F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, max(event_id) FILTER (r = 1) AS event_id, max(event_type) FILTER (r = 1) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY user_id")
def upsert_latest(t):
    return latest_per_key(t.events, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1000 + label ELSE label END AS label FROM embeddings")
def guarded_updates(t):
    base = t.embeddings.select("vec_id", "label")
    updates = base.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 1000).alias("label")).unionByName(base.select((F.col("vec_id") + 10_000_000).alias("vec_id"), "label"))
    return guarded_update(base, updates, "vec_id")[0]


@query("SELECT vec_id + 10000000 AS vec_id FROM embeddings")
def guarded_update_errors(t):
    base = t.embeddings.select("vec_id", "label")
    updates = base.unionByName(base.select((F.col("vec_id") + 10_000_000).alias("vec_id"), "label"))
    return guarded_update(base, updates, "vec_id")[1].select("vec_id")


@query("SELECT user_id, max(event_id) AS entries_upto, CAST(max(ts) + INTERVAL 7 DAY AS VARCHAR)[1:10] AS expires FROM events GROUP BY user_id")
def expiring_entries(t):
    latest = t.events.groupBy("user_id").agg(F.max("event_id").alias("entries_upto"), F.max("ts").alias("ts"))
    return latest.select("user_id", "entries_upto", F.substring((F.col("ts") + F.expr("INTERVAL 7 DAYS")).cast("string"), 1, 10).alias("expires"))


@query("SELECT label AS collection, count(*) AS n, max(len(embedding)) AS dimension FROM embeddings GROUP BY 1")
def vector_collections(t):
    return collection_stats(t.embeddings.withColumnRenamed("label", "collection"), "collection", "embedding")


@query(r"SELECT doc_id, md5(substr(trim(lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}\s.,\-:€]', ' ', 'g'), '\s+', ' ', 'g'))), 1, 8192)) AS cleaned FROM documents")
def clean_texts(t):
    return t.documents.select("doc_id", F.md5(S.clean_text(F.col("text"))).alias("cleaned"))


@query("SELECT o_orderkey AS invoice_id, lower(concat_ws(' ', o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR))) AS content FROM orders")
def text_content(t):
    return t.orders.select(F.col("o_orderkey").alias("invoice_id"), F.lower(F.concat_ws(" ", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("content"))


@query("SELECT o_orderkey AS invoice_id, concat_ws(' | ', 'Kunde: ' || CAST(o_custkey AS VARCHAR), 'Nummer: ' || CAST(o_orderkey AS VARCHAR), 'Status: ' || nullif(o_orderstatus, 'O'), 'Art: ' || o_orderpriority) AS structured FROM orders")
def structured_text(t):
    def part(label, x):
        return F.when(x.isNotNull(), F.concat(F.lit(label), x.cast("string")))

    return t.orders.select(F.col("o_orderkey").alias("invoice_id"), F.concat_ws(" | ", part("Kunde: ", F.col("o_custkey")), part("Nummer: ", F.col("o_orderkey")), part("Status: ", F.nullif(F.col("o_orderstatus"), F.lit("O"))), part("Art: ", F.col("o_orderpriority"))).alias("structured"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN length(text) >= 20 THEN text ELSE '' END, ''), concat_ws(chr(10), lang, source)) AS full_text FROM documents")
def full_text(t):
    raw = F.when(F.length("text") >= 20, F.col("text")).otherwise("")
    return t.documents.select("doc_id", F.coalesce(F.nullif(raw, F.lit("")), F.concat_ws("\n", "lang", "source")).alias("full_text"))


@query("SELECT doc_id, coalesce(nullif(text, ''), concat_ws(chr(10), lang, source)) AS full_text FROM documents")
def full_text_all(t):
    """full_text with short texts too."""
    return t.documents.select("doc_id", F.coalesce(F.nullif("text", F.lit("")), F.concat_ws("\n", "lang", "source")).alias("full_text"))


@query(f"WITH {ITEMS_SQL} SELECT invoice_id, position, 'Artikel: ' || description || ' Lieferant: ' || supplier || ' Konto: ' || account AS document, count(*) AS n FROM items GROUP BY ALL")
def vector_documents(t):
    d = invoice_items(t).select("invoice_id", "position", F.format_string("Artikel: %s Lieferant: %s Konto: %s", "description", "supplier", "account").alias("document"))
    return d.groupBy("invoice_id", "position", "document").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 10 THEN 'niedrig' WHEN p_retailprice < 100 THEN 'mittel' WHEN p_retailprice < 800 THEN 'hoch' ELSE 'anlagevermögen' END AS price_range FROM part")
def price_ranges(t):
    return t.part.select("p_partkey", S.price_range(F.col("p_retailprice")).alias("price_range"))


@query("SELECT o_orderkey, CASE WHEN coalesce(o_totalprice, 0) = 0 THEN 'unknown' WHEN o_totalprice < 50 THEN 'small' WHEN o_totalprice < 500 THEN 'medium' WHEN o_totalprice < 2000 THEN 'large' ELSE 'very_large' END AS category, o_totalprice < 100 AS is_small, o_totalprice > 1000 AS is_large, o_totalprice > 5000 AS is_industrial FROM orders")
def total_categories(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", S.total_category(p).alias("category"), (p < 100).alias("is_small"), (p > 1000).alias("is_large"), (p > 5000).alias("is_industrial"))


@query("SELECT CASE WHEN o_totalprice < 100 THEN 'klein' WHEN o_totalprice < 1000 THEN 'mittel' ELSE 'gross' END AS band, count(*) AS n FROM orders GROUP BY 1")
def total_bands(t):
    return t.orders.groupBy(S.total_band(F.col("o_totalprice")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


BAND = "CASE WHEN c >= 0.9 THEN 'excellent' WHEN c >= 0.8 THEN 'high' WHEN c >= 0.65 THEN 'good' WHEN c >= 0.5 THEN 'medium' WHEN c >= 0.3 THEN 'low' ELSE 'poor' END"


@query(f"SELECT event_id, {BAND} AS quality, CASE WHEN {BAND} IN ('high', 'medium', 'low', 'poor') THEN {BAND} ELSE 'medium' END AS stored_quality, (event_type <> 'error') AND c >= 0.5 AND {BAND} IN ('high', 'medium') AS success FROM (SELECT *, least(value / 100, 1.0) AS c FROM events)")
def quality_bands(t):
    m = metrics(t)
    band = S.quality_band(F.col("confidence"))
    return m.select(F.col("run_id").alias("event_id"), band.alias("quality"), S.stored_quality(band).alias("stored_quality"), S.successful(F.col("error").cast("int"), F.col("confidence"), band).alias("success"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 WHEN n <= 10 THEN 0.005 WHEN n <= 50 THEN 0.015 ELSE 0.03 END AS cost FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)")
def processing_costs(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(n, "o_orderkey", "left").select("o_orderkey", S.cost_estimate(F.coalesce("n", F.lit(0)), F.col("o_orderstatus") == "F").alias("cost"))


@query("SELECT doc_id, c AS category, CASE c WHEN 'small' THEN 1.0 WHEN 'medium' THEN 1.5 WHEN 'large' THEN 3.0 ELSE 6.0 END AS timeout_factor, round(least(1.0, 1000.0 / nullif(n_chars, 0)), 6) AS compression FROM (SELECT *, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 2000 THEN 'medium' WHEN n_chars < 10000 THEN 'large' ELSE 'huge' END AS c FROM documents)")
def size_categories(t):
    c = S.size_category(F.col("n_chars"), (500, 2000, 10000))
    return t.documents.select("doc_id", c.alias("category"), S.timeout_factor(c).alias("timeout_factor"), F.round(F.least(F.lit(1.0), F.try_divide(F.lit(1000.0), F.col("n_chars"))), 6).alias("compression"))


@query("SELECT l_orderkey, CAST(round(l_tax * 100) AS INT) AS rate, CAST(round(l_tax * 100) AS INT) IN (0, 7, 19) AS valid, count(*) AS n FROM lineitem GROUP BY ALL")
def vat_rate_check(t):
    rate = F.round(F.col("l_tax") * 100).cast("int")
    return t.lineitem.groupBy("l_orderkey", rate.alias("rate"), S.valid_vat_rate(rate).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, a AS account, regexp_full_match(a, '[0-9]{4}') AND coalesce(TRY_CAST(a AS INT) BETWEEN 1000 AND 9999, FALSE) AS valid, a[1] = CAST(p_size % 4 AS VARCHAR) AS class_ok FROM (SELECT *, CASE WHEN p_size < 10 THEN lpad(CAST(p_size * 49 AS VARCHAR), 4, '0') ELSE CAST(p_size * 100 AS VARCHAR) END AS a FROM part)")
def account_checks(t):
    a = F.when(F.col("p_size") < 10, F.lpad((F.col("p_size") * 49).cast("string"), 4, "0")).otherwise((F.col("p_size") * 100).cast("string"))
    return t.part.select("p_partkey", a.alias("account"), S.valid_account(a).alias("valid"), S.class_matches(a, F.col("p_size") % 4).alias("class_ok"))


@query("""SELECT c_custkey, regexp_full_match(plz, '[0-9]{5}') AND coalesce(TRY_CAST(plz AS INT) >= 1000, FALSE) AS plz_ok,
 (starts_with(bare, '+49') OR starts_with(bare, '0')) AND length(bare) >= 10 AS phone_ok, regexp_full_match(ust, 'DE[0-9]{9}') AS ust_ok
 FROM (SELECT *, replace(replace(replace(phone, ' ', ''), '-', ''), '/', '') AS bare FROM (SELECT c_custkey, CAST(c_custkey * 37 AS VARCHAR) AS plz,
 CASE WHEN c_custkey % 2 = 0 THEN '+49 30-' ELSE '12/' END || CAST(c_custkey * 1000 AS VARCHAR) AS phone, 'DE' || lpad(CAST(c_custkey * 7919 AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 9 END, '0') AS ust FROM customer))""")
def contact_checks(t):
    k = F.col("c_custkey")
    plz = (k * 37).cast("string")
    phone = F.concat(F.when(k % 2 == 0, "+49 30-").otherwise("12/"), (k * 1000).cast("string"))
    ust = F.concat(F.lit("DE"), F.when(k % 3 == 0, F.lpad((k * 7919).cast("string"), 8, "0")).otherwise(F.lpad((k * 7919).cast("string"), 9, "0")))
    return t.customer.select("c_custkey", S.valid_postcode(plz).alias("plz_ok"), S.valid_phone(phone).alias("phone_ok"), S.valid_vat_id(ust).alias("ust_ok"))


LINE = "CAST(l_extendedprice AS DECIMAL(15,2)) AS net, CAST(l_quantity AS DECIMAL(12,3)) AS q, CAST(l_extendedprice / l_quantity AS DECIMAL(15,2)) AS p"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(net AS DOUBLE) AS net, abs(net - q * p) <= 0.01 AS total_ok, count(*) AS n FROM (SELECT *, {LINE} FROM lineitem) GROUP BY ALL")
def line_total_checks(t):
    net, q, p = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_quantity").cast("decimal(12,3)"), F.try_divide("l_extendedprice", "l_quantity").cast("decimal(15,2)")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey", net.cast("double").alias("net"), (F.abs(net - q * p) <= F.lit("0.01").cast("decimal(4,2)")).alias("total_ok")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, count(*) AS lines, CAST(sum(n) AS DOUBLE) AS net, CAST(sum(n * r) AS DOUBLE) AS vat, CAST(sum(n + n * r) AS DOUBLE) AS gross FROM (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(15,2)) AS n, CAST(l_tax AS DECIMAL(4,2)) AS r FROM lineitem) GROUP BY 1")
def line_totals(t):
    n, r = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_tax").cast("decimal(4,2)")
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(n).cast("double").alias("net"), F.sum(n * r).cast("double").alias("vat"), F.sum(n + n * r).cast("double").alias("gross"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_orderdate <= ship THEN 'service date' END, CASE WHEN NOT coalesce(regexp_full_match(CAST(o_orderkey AS VARCHAR), '[0-9]{3,}'), FALSE) THEN 'number' END,
 CASE WHEN NOT (o_custkey % 400 BETWEEN 1 AND 365) THEN 'payment days' END, CASE WHEN ship IS NULL THEN 'no items' END], lambda x: x IS NOT NULL), ',') AS violations
 FROM (SELECT o_orderkey, o_custkey, o_orderdate, min(l_shipdate) AS ship FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)""")
def header_violations(t):
    ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    found = S.violations((F.col("ship").isNull() | (F.col("o_orderdate") <= F.col("ship")), "service date"), (F.col("o_orderkey").cast("string").rlike("^[0-9]{3,}$"), "number"), ((F.col("o_custkey") % 400).between(1, 365), "payment days"), (F.col("ship").isNotNull(), "no items"))
    return t.orders.join(ship, "o_orderkey", "left").select("o_orderkey", F.array_join(found, ",").alias("violations"))


@query("SELECT l_orderkey, abs(CAST(sum(n) AS DOUBLE) - CAST(sum(n) FILTER (t <= 4) AS DOUBLE) - coalesce(CAST(sum(n) FILTER (t > 4) AS DOUBLE), 0)) <= 0.01 AS net_ok FROM (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(15,2)) AS n, CAST(round(l_tax * 100) AS INT) AS t FROM lineitem) GROUP BY 1 HAVING count(*) FILTER (t <= 4) > 0")
def footer_totals(t):
    n, r = F.col("l_extendedprice").cast("decimal(15,2)"), F.round(F.col("l_tax") * 100).cast("int")
    sums = t.lineitem.groupBy("l_orderkey").agg(F.sum(n).alias("all"), F.sum(F.when(r <= 4, n)).alias("low"), F.coalesce(F.sum(F.when(r > 4, n)), F.lit(0)).alias("high")).where("low IS NOT NULL")
    return sums.select("l_orderkey", (F.abs(F.col("all") - F.col("low") - F.col("high")) <= F.lit("0.01").cast("decimal(4,2)")).alias("net_ok"))


@query("""SELECT v AS violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_linenumber NOT BETWEEN 1 AND 4 THEN 'position' END, CASE WHEN l_quantity NOT BETWEEN 1 AND 45 THEN 'quantity' END,
 CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END], lambda x: x IS NOT NULL)) AS v FROM lineitem) GROUP BY 1""")
def violation_report(t):
    found = S.violations((F.col("l_linenumber").between(1, 4), "position"), (F.col("l_quantity").between(1, 45), "quantity"), (F.col("l_discount") <= 0.08, "discount"), (F.col("l_returnflag").isin("A", "N"), "flag"))
    return t.lineitem.select(F.explode(found).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(m.message, 'Unbekannter Fehler') AS message, count(*) AS n FROM events e LEFT JOIN (VALUES ('error', 'Fehler'), ('click', 'Warnung')) AS m(kind, message) ON e.event_type = m.kind GROUP BY 1""")
def violation_messages(t):
    table = t.spark.createDataFrame([("error", "Fehler"), ("click", "Warnung")], "event_type string, message string")
    return t.events.join(F.broadcast(table), "event_type", "left").groupBy(F.coalesce("message", F.lit("Unbekannter Fehler")).alias("message")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN c < 0.5 THEN 'low confidence' END, CASE WHEN value * 10 > 1000 THEN 'slow' END], lambda x: x IS NOT NULL), ';') AS warnings FROM (SELECT *, least(value / 100, 1.0) AS c FROM events)")
def result_warnings(t):
    return metrics(t).select(F.col("run_id").alias("event_id"), F.array_join(S.violations((F.col("confidence") >= 0.5, "low confidence"), (F.col("time_ms") <= 1000, "slow")), ";").alias("warnings"))


@query("""SELECT o_orderkey, array_to_string(list_concat(CASE WHEN o_totalprice < 1000 THEN ['header: total'] ELSE [] END, coalesce(e, [])), ';') AS errors FROM orders LEFT JOIN
 (SELECT l_orderkey, list_sort(list('item ' || CAST(l_linenumber AS VARCHAR) || ': quantity')) AS e FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_orderkey = o_orderkey""")
def sectioned_errors(t):
    items = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.concat(F.lit("item "), F.col("l_linenumber").cast("string"), F.lit(": quantity")))).alias("e"))
    header = F.when(F.col("o_totalprice") < 1000, F.array(F.lit("header: total"))).otherwise(F.array().cast("array<string>"))
    return t.orders.join(items, "o_orderkey", "left").select("o_orderkey", F.array_join(F.concat(header, F.coalesce("e", F.array().cast("array<string>"))), ";").alias("errors"))


@query("SELECT page_id, suffix(url, '.html') AS html_path, regexp_matches(url, '^https?://[a-z0-9.-]+') AS absolute FROM pages")
def path_checks(t):
    return t.pages.select("page_id", F.col("url").endswith(".html").alias("html_path"), F.col("url").rlike("^https?://[a-z0-9.-]+").alias("absolute"))


@query("SELECT count(*) FILTER (l_quantity <= 0) AS quantity, count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) AS discount, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS flag, count(*) FILTER (l_linenumber > 6) AS position, count(*) AS total FROM lineitem")
def table_constraints(t):
    return t.lineitem.agg(F.count_if(F.col("l_quantity") <= 0).alias("quantity"), F.count_if(~F.col("l_discount").between(0, 0.05)).alias("discount"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("flag"), F.count_if(F.col("l_linenumber") > 6).alias("position"), F.count(F.lit(1)).alias("total"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS amount FROM orders")
def parsed_amounts(t):
    euro = F.concat(F.translate(F.format_number(F.col("o_totalprice").cast("decimal(15,2)"), 2), ",.", ".,"), F.lit(" €"))
    return t.orders.select("o_orderkey", S.parse_amount(euro).alias("amount"))


@query("SELECT p_partkey, replace(replace(replace(printf('%,.2f', p_retailprice), ',', '#'), '.', ','), '#', '.') || ' EUR' AS amount FROM part")
def formatted_amounts(t):
    return t.part.select("p_partkey", S.format_currency(F.col("p_retailprice")).alias("amount"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Stk' WHEN 1 THEN 'kg' WHEN 2 THEN 'Rolle' ELSE 'm' END AS unit FROM part")
def normalized_units(t):
    raw = F.element_at(F.array(F.lit("STÜCK"), F.lit("Kilogramm"), F.lit("Rolle"), F.lit("mtr")), (F.col("p_size") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", S.normalize_unit(raw).alias("unit"))


@query("SELECT page_id, CASE WHEN contains(url, 'site1') THEN 'first' WHEN contains(url, 'site2') THEN 'second' WHEN contains(url, 'blog') THEN 'blog' ELSE 'unknown' END AS supplier, CASE WHEN contains(url, 'site1') THEN 1 WHEN contains(url, 'site2') THEN 2 ELSE 999 END AS priority FROM pages")
def supplier_from_path(t):
    u = F.col("url")
    return t.pages.select("page_id", S.first_keyword(u, [("site1", "first"), ("site2", "second"), ("blog", "blog")], "unknown").alias("supplier"), F.when(u.contains("site1"), 1).when(u.contains("site2"), 2).otherwise(999).alias("priority"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity, CASE event_type WHEN 'error' THEN 'retry' WHEN 'purchase' THEN 'check' ELSE 'none' END || CASE WHEN contains(props, '1') THEN ' now' ELSE '' END AS suggestion FROM events")
def error_severity(t):
    table = t.spark.createDataFrame([("error", "high", "retry"), ("purchase", "medium", "check")], "event_type string, severity string, hint string")
    return t.events.join(F.broadcast(table), "event_type", "left").select("event_id", F.coalesce("severity", F.lit("low")).alias("severity"), F.concat(F.coalesce("hint", F.lit("none")), F.when(F.col("props").contains("1"), " now").otherwise("")).alias("suggestion"))


@query("SELECT event_type, n, CASE WHEN event_type = 'error' AND n > 100 THEN 'investigate' WHEN n > 1000 THEN 'watch' ELSE 'fine' END AS recommendation FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def error_recommendations(t):
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("recommendation", F.when((F.col("event_type") == "error") & (F.col("n") > 100), "investigate").when(F.col("n") > 1000, "watch").otherwise("fine"))


@query("SELECT s_suppkey, CASE WHEN contains(lower(s_name), '#00000001') THEN '3401' WHEN contains(lower(s_name), '1') THEN '3402' WHEN contains(lower(s_name), '2') THEN '3403' END AS account, CASE WHEN contains(lower(s_name), '1') OR contains(lower(s_name), '2') THEN 0.8 ELSE 0.0 END AS confidence FROM supplier")
def accounts_by_supplier(t):
    account = S.first_keyword(F.lower("s_name"), [("#00000001", "3401"), ("1", "3402"), ("2", "3403")])
    return t.supplier.select("s_suppkey", account.alias("account"), F.when(account.isNotNull(), 0.8).otherwise(0.0).alias("confidence"))


@query("SELECT CAST(round(l_tax * 100) AS INT) AS rate, a.account, count(*) AS n FROM lineitem LEFT JOIN (VALUES (0, '1570'), (7, '1571'), (5, '1575')) AS a(rate, account) ON a.rate = CAST(round(l_tax * 100) AS INT) GROUP BY 1, 2")
def vat_accounts(t):
    table = t.spark.createDataFrame([(0, "1570"), (7, "1571"), (5, "1575")], "rate int, account string")
    return t.lineitem.withColumn("rate", F.round(F.col("l_tax") * 100).cast("int")).join(F.broadcast(table), "rate", "left").groupBy("rate", "account").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'bolt|ring|rod') THEN 'material' WHEN regexp_matches(p_name, 'gear|widget') THEN 'tools' WHEN regexp_matches(p_name, 'red|blue') THEN 'other' ELSE 'default' END AS category, CASE WHEN regexp_matches(p_name, 'bolt|ring|rod|gear|widget|red|blue') THEN 0.7 ELSE 0.6 END AS confidence FROM part")
def fallback_classification(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", F.when(n.rlike("bolt|ring|rod"), "material").when(n.rlike("gear|widget"), "tools").when(n.rlike("red|blue"), "other").otherwise("default").alias("category"), F.when(n.rlike("bolt|ring|rod|gear|widget|red|blue"), 0.7).otherwise(0.6).alias("confidence"))


@query("SELECT doc_id, array_to_string(terms, ',') AS terms, CASE terms[1] WHEN 'the' THEN '3400' WHEN 'der' THEN '3410' WHEN 'que' THEN '3420' ELSE '6300' END AS account FROM (SELECT doc_id, list_filter(['the', 'der', 'que'], lambda k: contains(lower(text), k)) AS terms FROM documents)")
def key_terms(t):
    terms = F.filter(F.array(F.lit("the"), F.lit("der"), F.lit("que")), lambda k: F.contains(F.lower("text"), k))
    first = F.get(terms, F.lit(0))
    return t.documents.select("doc_id", F.array_join(terms, ",").alias("terms"), F.when(first == "the", "3400").when(first == "der", "3410").when(first == "que", "3420").otherwise("6300").alias("account"))


@query("SELECT route, count(*) AS n, sum(n_chars) AS chars FROM (SELECT n_chars, CASE WHEN n_chars > 5000 THEN 'remote' WHEN n_chars > 500 THEN 'hybrid' ELSE 'local' END AS route FROM documents) GROUP BY 1")
def strategy_routes(t):
    d = t.documents.withColumn("route", F.when(F.col("n_chars") > 5000, "remote").when(F.col("n_chars") > 500, "hybrid").otherwise("local"))
    return d.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {METRICS_SQL} SELECT run_id, CASE WHEN time_ms = 0 THEN 'fallback' WHEN confidence >= 0.75 THEN 'local' ELSE 'remote' END AS source, round(least(greatest(confidence * 1.2, 0.1), 0.95), 6) AS threshold FROM metrics")
def confidence_router(t):
    return metrics(t).select("run_id", F.when(F.col("time_ms") == 0, "fallback").when(F.col("confidence") >= 0.75, "local").otherwise("remote").alias("source"), F.round(S.clamp(F.col("confidence") * 1.2, 0.1, 0.95), 6).alias("threshold"))
