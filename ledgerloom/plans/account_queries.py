"""Queries of account assignment, quality, totals and their joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quality as Q
from ..operators import rules as R
from ..sources import files
from ..sources.files import rule_catalogue
from ..sources.scratch import stored, work_folder
from ..sources.tables import FEEDBACK_SQL, ITEMS_SQL, METRICS_SQL, feedback, invoice_items, metrics
from .registry import query

#: A catalogue of words that occur in the test tables.
RULES = [
    ("fasteners", ["bolt", "ring", "rod"], "3400"),
    ("machines", ["gear", "widget", "gizmo", "anvil"], "3410"),
    ("plates", ["plate", "large", "promo"], "0480"),
    ("finish", ["red", "blue", "hot", "cold"], "3430"),
    ("stock", ["small", "standard", "economy", "old", "new"], "3440"),
]
BRANDS = ["gear", "ring"]
RULE_ROWS = ", ".join(f"({i}, '{c}', {j}, '{k}', '{a}')" for i, (c, words, a) in enumerate(RULES) for j, k in enumerate(words))
RULES_SQL = f"rules(cat_ord, category, kw_ord, keyword, account) AS (VALUES {RULE_ROWS})"
WHOLE = "regexp_matches(lower(description), '(^|[^a-z0-9])' || keyword || '([^a-z0-9]|$)')"


def _best_sql(score: str) -> str:
    return f"""per AS (SELECT description, supplier, cat_ord, category, account, sum({score}) AS score, count(*) AS matches, array_to_string(list(keyword ORDER BY kw_ord), ',') AS keywords
 FROM (SELECT DISTINCT description, supplier FROM items) JOIN rules ON contains(lower(description), keyword) GROUP BY ALL),
 best AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY description, supplier ORDER BY score DESC, cat_ord) = 1)"""


BEST_SQL = _best_sql(f"1 + 0.1 * length(keyword) + CASE WHEN contains(lower(supplier), keyword) THEN 2.0 ELSE 0.0 END + CASE WHEN {WHOLE} THEN 0.5 ELSE 0.0 END")
CLASSIFIED_SQL = f"""{ITEMS_SQL}, {RULES_SQL}, {BEST_SQL}, classified AS (SELECT i.* EXCLUDE (account), coalesce(b.category, 'default') AS category,
 CASE WHEN coalesce(TRY_CAST(b.account AS INT) BETWEEN 1000 AND 9999, FALSE) THEN b.account ELSE '3400' END AS account,
 CASE WHEN b.score IS NULL THEN 0.2 ELSE least(0.8, 0.3 + 0.05 * b.score) + least(0.15, 0.03 * b.matches) END AS confidence, coalesce(b.keywords, '') AS keywords, coalesce(b.matches, 0) AS n_keywords
 FROM items i LEFT JOIN best b ON i.description = b.description AND i.supplier = b.supplier)"""


def classified(t):
    return R.classify_by_rules(invoice_items(t), rule_catalogue(t.spark, RULES))


@query(f"WITH {CLASSIFIED_SQL} SELECT supplier, account, count(*) AS n, round(avg(confidence), 10) AS confidence FROM classified GROUP BY 1, 2")
def supplier_account_distribution(t):
    return classified(t).groupBy("supplier", "account").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 10).alias("confidence"))


@query(f"WITH {CLASSIFIED_SQL} SELECT invoice_id, position, description, category, account, round(confidence, 6) AS confidence, keywords, count(*) AS n FROM classified GROUP BY ALL")
def rule_classifier(t):
    c = classified(t).withColumn("keywords", F.array_join("keywords", ","))
    return c.groupBy("invoice_id", "position", "description", "category", "account", F.round("confidence", 6).alias("confidence"), "keywords").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ITEMS_SQL}, {RULES_SQL}, {_best_sql("1 + length(keyword) / 10")} SELECT i.description, b.account, round(CASE WHEN b.score IS NULL THEN 0.2 ELSE least(0.95, least(0.9, 0.3 + 0.1 * b.score) + least(0.2, 0.05 * b.matches) + CASE WHEN regexp_matches(lower(i.description), 'gear|ring') THEN 0.15 ELSE 0 END) END, 6) AS confidence, count(*) AS n
 FROM items i LEFT JOIN best b ON i.description = b.description AND i.supplier = b.supplier GROUP BY 1, 2, 3""")
def rule_classifier_simple(t):
    c = R.classify_by_rules_simple(invoice_items(t), rule_catalogue(t.spark, RULES), BRANDS)
    return c.groupBy("description", "account", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLASSIFIED_SQL} SELECT category, account, keywords, count(*) AS n, round(avg(confidence), 10) AS confidence FROM classified GROUP BY 1, 2, 3")
def catalogue_classifier(t):
    """Items classified by a catalogue that is written as YAML and read from its file."""
    path = work_folder(t.spark, "catalogue")
    files.write_catalogue_yaml(t.spark, RULES, path)
    c = R.classify_by_rules(invoice_items(t), files.read_catalogue_yaml(t.spark, path)).withColumn("keywords", F.array_join("keywords", ","))
    return c.groupBy("category", "account", "keywords").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 10).alias("confidence"))


LARGE_SQL = """names AS (SELECT lower(p_brand || ' ' || p_type || ' ' || p_name) AS keyword, min(p_size) AS size FROM part GROUP BY 1), rules AS (SELECT row_number() OVER (ORDER BY keyword) AS cat_ord, keyword AS category, 0 AS kw_ord, keyword, '3' || lpad(CAST(size AS VARCHAR), 3, '0') AS account FROM names)"""


@query(f"""WITH {ITEMS_SQL}, {LARGE_SQL}, {BEST_SQL} SELECT coalesce(category, 'default') AS category, CASE WHEN coalesce(TRY_CAST(b.account AS INT) BETWEEN 1000 AND 9999, FALSE) THEN b.account ELSE '3400' END AS account, count(*) AS n,
 round(avg(CASE WHEN b.score IS NULL THEN 0.2 ELSE least(0.8, 0.3 + 0.05 * b.score) + least(0.15, 0.03 * b.matches) END), 10) AS confidence FROM items i LEFT JOIN best b ON i.description = b.description AND i.supplier = b.supplier GROUP BY 1, 2""")
def large_catalogue_classifier(t):
    """Items classified by a catalogue with a category for every part, found by an automaton where it is too large for the plan."""
    names = t.part.groupBy(F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name")).alias("keyword")).agg(F.min("p_size").alias("size"))
    rules = names.select(F.row_number().over(Window.orderBy("keyword")).alias("cat_ord"), F.col("keyword").alias("category"), F.lit(0).alias("kw_ord"), "keyword", F.concat(F.lit("3"), F.lpad(F.col("size").cast("string"), 3, "0")).alias("account"))
    c = R.classify_by_rules(invoice_items(t), rules)
    return c.groupBy("category", "account").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 10).alias("confidence"))


@query(f"WITH {ITEMS_SQL}, plan AS (SELECT DISTINCT '3' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS account FROM part WHERE p_size % 2 = 0) SELECT i.account, p.account IS NOT NULL AS valid, count(*) AS n FROM items i LEFT JOIN plan p ON p.account = i.account GROUP BY 1, 2")
def account_plan_check(t):
    plan = t.part.where("p_size % 2 = 0").select(F.concat(F.lit("3"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("account")).distinct().withColumn("known", F.lit(True))
    return invoice_items(t).join(plan, "account", "left").groupBy("account", F.coalesce("known", F.lit(False)).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


# The neighbour side of an item: its own account with a similarity that follows the quantity.
RAG_SQL = "least(1.0, quantity / 50) AS rag_conf"
METHOD = "CASE WHEN rag_conf < 0.2 THEN 'rule_fallback' WHEN confidence >= 0.7 AND rag_conf < 0.4 THEN 'rule_dominant' WHEN rag_conf >= 0.7 AND confidence < 0.4 THEN 'rag_dominant' WHEN account = rag_account THEN 'consensus' ELSE 'conflict' END"
COMBINED_SQL = f"""{CLASSIFIED_SQL}, both_ AS (SELECT *, {RAG_SQL}, '34' || substr(CAST(l_partkey AS VARCHAR), 1, 1) || '0' AS rag_account FROM classified),
 combined AS (SELECT *, {METHOD} AS method, CASE {METHOD} WHEN 'rule_fallback' THEN confidence WHEN 'rule_dominant' THEN confidence WHEN 'rag_dominant' THEN rag_conf WHEN 'consensus' THEN (confidence + rag_conf) / 2 ELSE greatest(confidence, rag_conf) * 0.9 END AS final FROM both_)"""


def combined(t):
    c = classified(t).withColumn("rag_conf", F.least(F.lit(1.0), F.col("quantity") / 50)).withColumn("rag_account", F.concat(F.lit("34"), F.substring(F.col("l_partkey").cast("string"), 1, 1), F.lit("0")))
    method, final = R.combine(F.col("confidence"), F.col("rag_conf"), F.col("account") == F.col("rag_account"))
    return c.withColumn("method", method).withColumn("final", final)


@query(f"WITH {COMBINED_SQL} SELECT method, account, count(*) AS n, round(avg(final), 10) AS confidence FROM combined GROUP BY 1, 2")
def combined_results(t):
    return combined(t).groupBy("method", "account").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final"), 10).alias("confidence"))


@query(f"WITH {COMBINED_SQL} SELECT invoice_id, count(*) AS items, round(avg(final), 10) AS confidence, count(*) FILTER (method = 'consensus') AS consensus FROM combined GROUP BY 1")
def classified_documents(t):
    return combined(t).groupBy("invoice_id").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("final"), 10).alias("confidence"), F.count_if(F.col("method") == "consensus").alias("consensus"))


@query(f"WITH {CLASSIFIED_SQL} SELECT supplier, round(sum(CASE WHEN s_acctbal > 0 THEN 0.1 * n_keywords / 4 ELSE 0 END), 4) AS boost FROM classified JOIN supplier ON s_name = supplier GROUP BY 1")
def supplier_context(t):
    context = t.supplier.where("s_acctbal > 0").select(F.col("s_name").alias("supplier"), F.lit(0.1).alias("boost"))
    c = classified(t).join(context, "supplier", "left")
    return c.groupBy("supplier").agg(F.round(F.sum(R.supplier_boost(F.size("keywords"), F.lit(4), F.col("boost"))), 4).alias("boost"))


PRICE_BOOST = "CASE WHEN price >= 800 AND starts_with(account, '04') THEN 0.20 WHEN price < 800 AND starts_with(account, '04') THEN -0.10 WHEN price < 100 AND starts_with(account, '3') THEN 0.15 WHEN price >= 100 AND starts_with(account, '3') THEN 0.12 ELSE 0.0 END"


@query(f"WITH {ITEMS_SQL} SELECT account, {PRICE_BOOST} AS boost, count(*) AS n FROM (SELECT price, CASE WHEN l_partkey % 2 = 0 THEN '0480' ELSE account END AS account FROM items) GROUP BY 1, 2")
def price_threshold_context(t):
    i = invoice_items(t).withColumn("account", F.when(F.col("l_partkey") % 2 == 0, "0480").otherwise(F.col("account")))
    return i.groupBy("account", R.price_boost(F.col("price"), F.col("account")).alias("boost")).agg(F.count(F.lit(1)).alias("n"))


TOKENS = "list_distinct(string_split(lower(description), ' '))"
SIMILAR_SQL = f"""x AS (SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY items.position, l_partkey, l_suppkey, net) AS pos, account, {TOKENS} AS t FROM items)"""


@query(f"""WITH {ITEMS_SQL}, {SIMILAR_SQL}, near AS (SELECT a.invoice_id, a.pos, count(*) AS n_similar, avg(CASE WHEN a.account = b.account THEN 1.0 ELSE 0.0 END) AS consistency FROM x a JOIN x b ON a.invoice_id = b.invoice_id AND a.pos <> b.pos
 WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) > 0.3 GROUP BY 1, 2)
 SELECT invoice_id, pos, n_similar, round(consistency, 6) AS consistency, CASE WHEN n_similar < 2 THEN 0.0 WHEN consistency >= 0.8 THEN 0.1 WHEN consistency <= 0.3 THEN -0.05 ELSE 0.0 END AS boost FROM near""")
def multi_position_context(t):
    pos = F.row_number().over(Window.partitionBy("invoice_id").orderBy("position", "l_partkey", "l_suppkey", "net"))
    i = invoice_items(t).withColumn("pos", pos).withColumn("item_id", F.struct("invoice_id", "pos"))
    return R.similar_positions(i, 0.3).select("item_id.invoice_id", "item_id.pos", F.col("similar").alias("n_similar"), F.round("consistency", 6).alias("consistency"), "boost")


@query(f"WITH {ITEMS_SQL}, season AS (SELECT account, month(shipped) AS m, count(*) AS f FROM items GROUP BY 1, 2) SELECT i.account, month(i.shipped) AS m, CASE WHEN f >= 150 THEN 0.05 ELSE 0.0 END AS boost, count(*) AS n FROM items i JOIN season s ON s.account = i.account AND s.m = month(i.shipped) GROUP BY 1, 2, 3")
def seasonal_context(t):
    i = invoice_items(t).withColumn("m", F.month("shipped"))
    season = i.groupBy("account", "m").agg(F.count(F.lit(1)).alias("f"))
    return i.join(season, ["account", "m"]).groupBy("account", "m", F.when(F.col("f") >= 150, 0.05).otherwise(0.0).alias("boost")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLASSIFIED_SQL}, b AS (SELECT *, {PRICE_BOOST} AS pb, CASE WHEN month(shipped) = 12 THEN 0.05 ELSE 0.0 END AS sb FROM classified)
 SELECT account, concat_ws(',', CASE WHEN pb <> 0 THEN 'price' END, CASE WHEN sb <> 0 THEN 'season' END) AS applied, count(*) AS n, round(avg(least(greatest(confidence + pb + sb, 0.05), 0.95)), 10) AS confidence FROM b GROUP BY 1, 2""")
def context_classifier(t):
    c = classified(t)
    conf, applied = R.with_context(F.col("confidence"), {"price": R.price_boost(F.col("price"), F.col("account")), "season": F.when(F.month("shipped") == 12, 0.05).otherwise(0.0)})
    c = c.withColumn("applied", F.array_join(applied, ",")).withColumn("final", conf)
    return c.groupBy("account", "applied").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final"), 10).alias("confidence"))


def corrected_lines(t, flag: str):
    """Corrections of items: every line with a flag, corrected to its part's account."""
    i = invoice_items(t, t.lineitem.where(F.col("l_returnflag") == flag))
    return i.select("supplier", "account", "description", "price", F.col("shipped").alias("ts"), F.struct("invoice_id", "position", "l_partkey", "net").alias("feedback_id"))


def corrections(t):
    """Every accepted line."""
    return corrected_lines(t, "A")


ACCEPTED_SQL, RETURNED_SQL = (ITEMS_SQL[:-1] + f" WHERE l_returnflag = '{flag}')" for flag in "AR")
PATTERNS_SQL = """patterns AS (SELECT supplier, account, substr(description, 1, 100) AS d, count(*) AS n, least(0.3, 0.05 * count(*)) AS boost, arg_min(price, (shipped, invoice_id, position, l_partkey, net)) AS first_price FROM items GROUP BY 1, 2, 3)"""


@query(f"WITH {ACCEPTED_SQL}, {PATTERNS_SQL} SELECT supplier, account, d AS description, n, round(boost, 4) AS boost, round(0.8 * first_price, 8) AS price_min, round(1.2 * first_price, 8) AS price_max FROM patterns")
def learned_patterns(t):
    p = R.learn_patterns(corrections(t))
    return p.select("supplier", "account", "description", "n", F.round("boost", 4).alias("boost"), F.round("price_min", 8).alias("price_min"), F.round("price_max", 8).alias("price_max"))


def returned(t):
    """Every returned line."""
    return corrected_lines(t, "R")


@query(f"WITH {RETURNED_SQL}, {PATTERNS_SQL} SELECT supplier, account, d AS description, n, round(boost, 4) AS boost, round(0.8 * first_price, 8) AS price_min, round(1.2 * first_price, 8) AS price_max FROM patterns")
def returned_patterns(t):
    """learned_patterns with the returned lines as corrections."""
    p = R.learn_patterns(returned(t))
    return p.select("supplier", "account", "description", "n", F.round("boost", 4).alias("boost"), F.round("price_min", 8).alias("price_min"), F.round("price_max", 8).alias("price_max"))


BOOSTS_SQL = f"""WITH {CLASSIFIED_SQL}, {PATTERNS_SQL.replace('FROM items', f'FROM (WITH {ACCEPTED_SQL} FROM items)')}, numbered AS (SELECT *, row_number() OVER (ORDER BY invoice_id, position, l_partkey, l_suppkey, net, quantity, rate, shipped) AS id FROM classified),
 met AS (SELECT c.id, p.account AS pa, c.account, p.boost, p.n, row_number() OVER (PARTITION BY c.id ORDER BY p.n DESC, p.account, lower(p.d)) AS r FROM numbered c JOIN patterns p ON c.supplier = p.supplier AND c.price BETWEEN 0.8 * p.first_price AND 1.2 * p.first_price AND contains(lower(c.description), lower(p.d))),
 total AS (SELECT id, sum(CASE WHEN pa = account THEN boost * n / 10 ELSE -0.1 * boost END) AS change FROM met WHERE r <= 3 GROUP BY 1)
 SELECT supplier, count(*) AS n, count(t.id) AS changed, round(avg(CASE WHEN t.change IS NULL THEN confidence ELSE least(1.0, confidence + t.change) END), 10) AS confidence FROM numbered LEFT JOIN total t USING (id) GROUP BY 1"""


@query(BOOSTS_SQL)
def feedback_boosts(t):
    return boosts(R.feedback_boost(numbered_items(t), R.learn_patterns(corrections(t))))


def numbered_items(t):
    """Classified items, stored with a number each: both sides of the boosts' joins start from there."""
    c = classified(t).select("supplier", "price", "description", "account", "confidence")
    return stored(c.withColumn("item_id", F.monotonically_increasing_id()), "items").withColumn("before", F.col("confidence"))


def boosts(out):
    return out.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") != F.col("before")).alias("changed"), F.round(F.avg("confidence"), 10).alias("confidence"))


@query(BOOSTS_SQL.replace(ACCEPTED_SQL, RETURNED_SQL))
def returned_boosts(t):
    """feedback_boosts with the patterns of the returned lines."""
    return boosts(R.feedback_boost(numbered_items(t), R.learn_patterns(returned(t))))


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS invoices, count(l_orderkey) AS items, count(*) FILTER (l_returnflag = 'R') AS returned, round(avg(p_retailprice), 8) AS price FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def invoice_complete(t):
    d = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return d.groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("invoices"), F.count("l_orderkey").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.round(F.avg("p_retailprice"), 8).alias("price"))


@query("SELECT c_custkey, count(DISTINCT o_orderkey) AS uploads, round(sum(o_totalprice), 2) AS total, count(o_totalprice) AS weight, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 2) AS accepted, CAST(max(o_orderdate) AS VARCHAR)[1:10] AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def user_analytics(t):
    d = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return d.groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("uploads"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("o_totalprice").alias("weight"), F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))), F.lit(0.0)), 2).alias("accepted"), F.substring(F.max("o_orderdate").cast("string"), 1, 10).alias("last"))


@query("WITH e AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1), as_of AS (SELECT max(ts) AS now FROM events) SELECT c_custkey AS key, CASE WHEN e.ts IS NULL THEN 'miss' WHEN e.ts + INTERVAL 3 DAY < now THEN 'expired' ELSE 'hit' END AS state FROM customer LEFT JOIN e ON user_id = c_custkey CROSS JOIN as_of")
def cache_lookup(t):
    entries = t.events.where("event_type = 'view'").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("ts"))
    now = t.events.agg(F.max("ts").alias("now"))
    d = t.customer.select(F.col("c_custkey").alias("key")).join(entries, "key", "left").join(F.broadcast(now))
    return d.select("key", F.when(F.col("ts").isNull(), "miss").when(F.col("ts") + F.expr("INTERVAL 3 DAYS") < F.col("now"), "expired").otherwise("hit").alias("state"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 3 = 0 AND sha256(p.text) = sha256(d.text))")
def unprocessed_documents(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.where("doc_id % 3 = 0").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("WITH latest AS (SELECT user_id, arg_max(md5(props), (ts, event_id)) AS h FROM events GROUP BY 1), first_ AS (SELECT user_id, arg_min(md5(props), (ts, event_id)) AS h FROM events GROUP BY 1) SELECT l.user_id, l.h IS DISTINCT FROM f.h AS changed FROM latest l JOIN first_ f USING (user_id)")
def content_changes(t):
    g = t.events.groupBy("user_id").agg(F.max_by(F.md5("props"), F.struct("ts", "event_id")).alias("a"), F.min_by(F.md5("props"), F.struct("ts", "event_id")).alias("b"))
    return g.select("user_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@query("WITH s AS (SELECT event_type AS strategy, avg(value) AS t, avg(least(value / 100, 1.0)) AS c, count(*) AS n FROM events GROUP BY 1) SELECT arg_min(strategy, t) AS fastest, arg_max(strategy, c) AS most_confident, arg_max(strategy, n) AS largest FROM s")
def strategy_comparison(t):
    s = metrics(t).groupBy(F.col("kind").alias("strategy")).agg(F.avg("time_ms").alias("t"), F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("n"))
    return s.agg(F.min_by("strategy", "t").alias("fastest"), F.max_by("strategy", "c").alias("most_confident"), F.max_by("strategy", "n").alias("largest"))


SCORE_SQL = f"""{COMBINED_SQL}, per_doc AS (SELECT invoice_id, count(*) AS items, avg(final) AS conf, avg(CASE WHEN contains(method, 'rag') THEN 1.0 ELSE 0.0 END) AS rag, avg(CASE WHEN quantity > 0 AND price > 0 AND description <> '' THEN 1.0 ELSE 0.0 END) AS complete, sum(net) FILTER (net > 0) AS total,
 avg(CASE WHEN keywords <> '' THEN 1.0 ELSE 0.0 END) AS kw, avg(CASE WHEN starts_with(account, '34') THEN 1.0 ELSE 0.0 END) AS acc, bool_or(contains(method, 'rule')) AS has_rule, bool_or(contains(method, 'rag')) AS has_rag FROM combined GROUP BY 1),
 scored AS (SELECT o_orderkey AS invoice_id, coalesce(items, 0) AS items, (CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END + CASE WHEN o_orderpriority <> '' THEN 1 ELSE 0 END) / 2.0 AS header, conf, rag, complete,
 CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 0.5 WHEN total IS NULL OR total <= 0 THEN 0.3 WHEN abs(o_totalprice - total) / o_totalprice <= 0.05 THEN 1.0 WHEN abs(o_totalprice - total) / o_totalprice <= 0.15 THEN 0.8 WHEN abs(o_totalprice - total) / o_totalprice <= 0.3 THEN 0.5 ELSE 0.2 END AS amounts,
 (kw + acc + CASE WHEN has_rule AND has_rag THEN 0.9 WHEN has_rule OR has_rag THEN 0.7 ELSE 0.3 END) / 3 AS domain FROM orders LEFT JOIN per_doc ON o_orderkey = invoice_id)"""


def scored(t):
    c = combined(t)
    one = F.lit(1.0)

    def share(x):
        return F.avg(F.when(x, one).otherwise(0.0))

    per = c.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("items"), F.avg("final").alias("conf"), share(F.col("method").contains("rag")).alias("rag"), share((F.col("quantity") > 0) & (F.col("price") > 0) & (F.col("description") != "")).alias("complete"), F.sum(F.when(F.col("net") > 0, F.col("net"))).alias("total"), share(F.size("keywords") > 0).alias("kw"), share(F.col("account").startswith("34")).alias("acc"), F.bool_or(F.col("method").contains("rule")).alias("has_rule"), F.bool_or(F.col("method").contains("rag")).alias("has_rag"))
    d = t.orders.join(per, F.col("o_orderkey") == F.col("invoice_id"), "left")
    domain = (F.col("kw") + F.col("acc") + Q.method_consistency(F.col("has_rule"), F.col("has_rag"))) / 3
    return d.select(F.col("o_orderkey").alias("invoice_id"), F.coalesce("items", F.lit(0)).alias("items"), Q.header_completeness(F.nullif("o_orderstatus", F.lit("O")), F.col("o_orderpriority")).alias("header"), "conf", "rag", "complete", Q.amount_consistency(F.col("o_totalprice"), F.col("total")).alias("amounts"), domain.alias("domain"))


TOTAL = "CASE WHEN items = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, 0.25 * header + 0.30 * conf + 0.15 * rag + 0.10 * complete + 0.10 * amounts + 0.05 * domain + 0.05 * 0.2)) END"
BAND = f"CASE WHEN {TOTAL} >= 0.9 THEN 'excellent' WHEN {TOTAL} >= 0.8 THEN 'high' WHEN {TOTAL} >= 0.65 THEN 'good' WHEN {TOTAL} >= 0.5 THEN 'medium' WHEN {TOTAL} >= 0.3 THEN 'low' ELSE 'poor' END"


@query(f"WITH {SCORE_SQL} SELECT invoice_id, items, round(header, 4) AS header, round(conf, 9) AS conf, round(rag, 9) AS rag, round(complete, 9) AS complete, amounts, round(domain, 9) AS domain, round({TOTAL}, 9) AS score FROM scored")
def document_scores(t):
    s = scored(t)
    total = Q.document_score(F.col("header"), F.col("conf"), F.col("rag"), F.col("complete"), F.col("amounts"), F.col("domain"), F.lit(0.2), F.col("items"))
    return s.select("invoice_id", "items", F.round("header", 4).alias("header"), F.round("conf", 9).alias("conf"), F.round("rag", 9).alias("rag"), F.round("complete", 9).alias("complete"), "amounts", F.round("domain", 9).alias("domain"), F.round(total, 9).alias("score"))


@query(f"WITH {SCORE_SQL}, b AS (SELECT {BAND} AS band, {TOTAL} AS score FROM scored) SELECT band, count(*) AS n, CASE band WHEN 'poor' THEN 'review' WHEN 'low' THEN 'review' WHEN 'medium' THEN 'spot check' ELSE 'accept' END AS recommendation, count(*) FILTER (score >= 0.8) AS high, count(*) FILTER (score < 0.5) AS low FROM b GROUP BY 1")
def quality_report(t):
    s = scored(t)
    total = Q.document_score(F.col("header"), F.col("conf"), F.col("rag"), F.col("complete"), F.col("amounts"), F.col("domain"), F.lit(0.2), F.col("items"))
    b = s.select(S.quality_band(total).alias("band"), total.alias("score"))
    g = b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.8).alias("high"), F.count_if(F.col("score") < 0.5).alias("low"))
    return g.withColumn("recommendation", F.when(F.col("band").isin("poor", "low"), "review").when(F.col("band") == "medium", "spot check").otherwise("accept"))


@query(f"WITH {ITEMS_SQL}, n AS (SELECT invoice_id, supplier, count(*) AS c FROM items GROUP BY 1, 2), m AS (SELECT invoice_id, supplier FROM n QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY c DESC, supplier) = 1) SELECT o_orderkey AS invoice_id, supplier AS detected, CASE WHEN supplier IS NULL AND o_orderstatus = 'O' THEN 0.2 WHEN supplier IS NULL THEN 0.6 WHEN o_orderstatus = 'O' THEN 0.7 WHEN contains('supplier#00000000' || CAST(o_custkey % 10 AS VARCHAR), lower(supplier)) OR contains(lower(supplier), 'supplier#00000000' || CAST(o_custkey % 10 AS VARCHAR)) THEN 1.0 ELSE 0.2 END AS recognition FROM orders LEFT JOIN m ON invoice_id = o_orderkey")
def supplier_recognition(t):
    m = Q.modal(invoice_items(t), "invoice_id", "supplier")
    header = F.when(F.col("o_orderstatus") == "O", "Not found").otherwise(F.concat(F.lit("Supplier#00000000"), (F.col("o_custkey") % 10).cast("string")))
    return t.orders.join(m, F.col("o_orderkey") == F.col("invoice_id"), "left").select(F.col("o_orderkey").alias("invoice_id"), F.col("supplier").alias("detected"), Q.supplier_recognition(header, F.col("supplier")).alias("recognition"))


@query(f"WITH {COMBINED_SQL} SELECT method, account, count(*) AS n, round(min(final), 6) AS low, round(max(final), 6) AS high, round(avg(final), 10) AS mean FROM combined GROUP BY 1, 2")
def detailed_quality_metrics(t):
    return combined(t).groupBy("method", "account").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("final"), 6).alias("low"), F.round(F.max("final"), 6).alias("high"), F.round(F.avg("final"), 10).alias("mean"))


@query(f"WITH {COMBINED_SQL} SELECT invoice_id, count(*) FILTER (final < 0.5) AS low_items, CASE WHEN avg(CASE WHEN final < 0.5 THEN 1.0 ELSE 0.0 END) > 0.3 THEN 'high' WHEN count(*) FILTER (final < 0.5) > 0 THEN 'low' ELSE 'none' END AS severity FROM combined GROUP BY 1")
def potential_issues(t):
    low = F.col("final") < 0.5
    g = combined(t).groupBy("invoice_id").agg(F.count_if(low).alias("low_items"), F.avg(low.cast("double")).alias("share"))
    return g.select("invoice_id", "low_items", F.when(F.col("share") > 0.3, "high").when(F.col("low_items") > 0, "low").otherwise("none").alias("severity"))


@query("""SELECT l_orderkey AS invoice_id, CAST(coalesce(sum(n) FILTER (r = 0), 0) AS DOUBLE) AS net_0, CAST(coalesce(sum(n) FILTER (r = 7), 0) AS DOUBLE) AS net_7, CAST(coalesce(sum(n) FILTER (r = 5), 0) AS DOUBLE) AS net_5, CAST(sum(n) AS DOUBLE) AS net, round(CAST(sum(n * r) AS DOUBLE) / 100, 4) AS vat
 FROM (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(15,2)) AS n, CAST(round(l_tax * 100) AS INT) AS r FROM lineitem) GROUP BY 1""")
def vat_totals(t):
    i = t.lineitem.select(F.col("l_orderkey").alias("invoice_id"), F.col("l_extendedprice").cast("decimal(15,2)").alias("net"), F.round(F.col("l_tax") * 100).cast("int").alias("rate"))
    v = Q.vat_totals(i, rates=(0, 7, 5))
    return v.select("invoice_id", *(F.col(f"net_{r}").cast("double").alias(f"net_{r}") for r in (0, 7, 5)), F.col("net").cast("double").alias("net"), F.round(F.col("vat").cast("double"), 4).alias("vat"))


@query("SELECT o_orderkey, coalesce(abs(o_totalprice - s) <= 0.01, FALSE) AS totals_ok, coalesce(n <> d, FALSE) AS duplicate_positions FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def invoice_validation(t):
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_linenumber").alias("d"))
    d = t.orders.join(g, "o_orderkey", "left")
    return d.select("o_orderkey", F.coalesce(F.abs(F.col("o_totalprice") - F.col("s")) <= 0.01, F.lit(False)).alias("totals_ok"), F.coalesce(F.col("n") != F.col("d"), F.lit(False)).alias("duplicate_positions"))


@query(f"""WITH {CLASSIFIED_SQL}, b AS (SELECT invoice_id, account, confidence, CAST(net AS DECIMAL(15,2)) AS amount, CASE WHEN position % 2 = 0 THEN 'S' ELSE 'H' END AS side FROM classified)
 SELECT invoice_id, CAST(coalesce(sum(amount) FILTER (side = 'S'), 0) - coalesce(sum(amount) FILTER (side = 'H'), 0) AS DOUBLE) AS balance, round(avg(confidence), 10) AS confidence, bool_or(confidence < 0.5) AS review, count(*) - count(DISTINCT account || side) AS duplicates FROM b GROUP BY 1""")
def booking_balance(t):
    b = classified(t).withColumn("amount", F.col("net").cast("decimal(15,2)")).withColumn("side", F.when(F.col("position") % 2 == 0, "S").otherwise("H"))
    debit, credit = (F.coalesce(F.sum(F.when(F.col("side") == s, F.col("amount"))), F.lit(0).cast("decimal(15,2)")) for s in "SH")
    return b.groupBy("invoice_id").agg((debit - credit).cast("double").alias("balance"), F.round(F.avg("confidence"), 10).alias("confidence"), F.bool_or(F.col("confidence") < 0.5).alias("review"), (F.count(F.lit(1)) - F.countDistinct(F.concat("account", "side"))).alias("duplicates"))


@query(f"WITH {FEEDBACK_SQL} SELECT account, count(*) AS n, round(avg(confidence), 10) AS confidence FROM feedback GROUP BY 1")
def account_summary(t):
    return feedback(t).groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 10).alias("confidence"))


@query(f"WITH {METRICS_SQL} SELECT CAST(hour(ts) AS INT) AS hour, round(sum(cost), 6) AS cost FROM metrics GROUP BY 1")
def hourly_costs(t):
    return metrics(t).groupBy(F.hour("ts").alias("hour")).agg(F.round(F.sum("cost"), 6).alias("cost"))
