"""Queries of issues, efficiency, encoders, training, gates and compared strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.plugins import FeaturePipeline
from ..operators import encoders as E
from ..operators import reports as P
from ..operators import rules as R
from ..operators import strategies as ST
from ..operators import training as T
from ..sources.files import rule_catalogue
from ..sources.scratch import work_folder
from ..sources.tables import ITEMS_SQL, METRICS_SQL, invoice_items, metrics
from .account_queries import BRANDS, CLASSIFIED_SQL, RULES, RULES_SQL, _best_sql
from .registry import query

SIMPLE_SQL = f"""{ITEMS_SQL}, {RULES_SQL}, {_best_sql("1 + length(keyword) / 10")}, simple AS (SELECT i.invoice_id, i.position, b.account, CASE WHEN b.score IS NULL THEN 0.2 ELSE least(0.95, least(0.9, 0.3 + 0.1 * b.score) + least(0.2, 0.05 * b.matches) + CASE WHEN regexp_matches(lower(i.description), 'gear|ring') THEN 0.15 ELSE 0 END) END AS confidence
 FROM items i LEFT JOIN best b ON i.description = b.description AND i.supplier = b.supplier)"""
HEADER_SQL = "header AS (SELECT o_orderkey AS invoice_id, CASE WHEN o_orderstatus = 'O' THEN ' ' ELSE o_orderstatus END AS supplier_name, CAST(o_orderkey AS VARCHAR) AS invoice_number, CASE WHEN month(o_orderdate) > 1 THEN CAST(o_orderdate AS VARCHAR) END AS date, CASE WHEN o_totalprice > 100000 THEN '' ELSE CAST(o_totalprice AS VARCHAR) END AS total_amount FROM orders)"


def header(t):
    """Orders as invoice headers: open ones have no supplier, January's no date, very large ones no total."""
    return t.orders.select(F.col("o_orderkey").alias("invoice_id"), F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus")).alias("supplier_name"), F.col("o_orderkey").cast("string").alias("invoice_number"), F.when(F.month("o_orderdate") > 1, F.col("o_orderdate").cast("string")).alias("date"), F.when(F.col("o_totalprice") > 100000, "").otherwise(F.col("o_totalprice").cast("string")).alias("total_amount"))


def simple(t):
    return R.classify_by_rules_simple(invoice_items(t), rule_catalogue(t.spark, RULES), BRANDS)


@query(f"WITH {HEADER_SQL} SELECT invoice_id, " + ", ".join(f"coalesce(trim({f}) <> '', FALSE) AS {f}" for f in P.HEADER_FIELDS) + " FROM header")
def header_completeness_flags(t):
    h = header(t)
    return h.select("invoice_id", *(c.alias(f) for f, c in P.header_flags(h).items()))


@query(f"""WITH {SIMPLE_SQL}, {HEADER_SQL}, counts AS (SELECT invoice_id, count(*) AS positions, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (account IS NULL) AS bare FROM simple GROUP BY 1),
 m AS (SELECT invoice_id, list_filter([{', '.join(f"CASE WHEN coalesce(trim({f}), '') = '' THEN '{f}' END" for f in P.HEADER_FIELDS)}], lambda x: x IS NOT NULL) AS missing FROM header), d AS (SELECT * FROM m LEFT JOIN counts USING (invoice_id))
 SELECT invoice_id, 'missing_header_data' AS type, 'medium' AS severity, CAST(len(missing) AS BIGINT) AS n, array_to_string(missing, ', ') AS description FROM d WHERE len(missing) > 0
 UNION ALL SELECT invoice_id, 'low_confidence_classifications', CASE WHEN low > positions * 0.3 THEN 'high' ELSE 'medium' END, low, low || ' positions of low confidence' FROM d WHERE low > 0
 UNION ALL SELECT invoice_id, 'missing_accounts', 'high', bare, bare || ' positions without account' FROM d WHERE bare > 0""")
def invoice_issues(t):
    """Every issue of every invoice: header fields, doubtful positions, positions without account."""
    return P.invoice_issues(header(t), simple(t))


@query(f"WITH {METRICS_SQL} SELECT kind, count(*) AS items, round(1000 / avg(time_ms), 4) AS items_per_second, round(sum(cost) / count(*), 4) AS cost_per_item, round(avg(confidence) / sum(cost), 4) AS confidence_per_cost FROM metrics GROUP BY 1")
def cost_efficiency(t):
    return P.cost_efficiency(metrics(t), "kind")


@query("SELECT CAST(ts AS VARCHAR)[1:19] AS at, event_type AS kind, props AS reason, value AS affected FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def last_invalidations(t):
    """The last ten, as the statistics list them."""
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select(F.substring(F.col("ts").cast("string"), 1, 19).alias("at"), F.col("event_type").alias("kind"), F.col("props").alias("reason"), F.col("value").alias("affected"))


def feature_run() -> FeaturePipeline:
    p = FeaturePipeline()
    p.add("text", lambda df: {"chars": F.length("text"), "address": F.nullif(F.regexp_extract("text", "[a-z0-9.]+@[a-z0-9.]+", 0), F.lit(""))})
    p.add("number", lambda df: {"long": F.nullif(F.regexp_extract("text", "[0-9]{13,16}", 0), F.lit("")), "ip": F.nullif(F.regexp_extract("text", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0), F.lit(""))})
    return p.add("broken", lambda df: {"x": df.no_such_column})


FEATURES_SQL = r"f AS (SELECT CAST(text IS NOT NULL AS INT) AS a, CAST(regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') AS INT) AS b, CAST(regexp_matches(text, '[0-9]{13,16}') AS INT) AS c, CAST(regexp_matches(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}') AS INT) AS d FROM documents), p AS (SELECT 'text' AS producer, a + b AS k FROM f UNION ALL SELECT 'number', c + d FROM f UNION ALL SELECT 'broken', 0 FROM f)"


@query(f"WITH {FEATURES_SQL} SELECT producer, count(*) FILTER (k > 0) AS success_count, CAST(sum(k) AS BIGINT) AS total_features, round(coalesce(sum(k) / nullif(count(*) FILTER (k > 0), 0), 0), 9) AS avg_features, round(count(*) FILTER (k > 0) / count(*), 9) AS success_rate FROM p GROUP BY 1")
def producer_report(t):
    """What each feature producer gave over all documents."""
    producers, _ = P.feature_report(t.documents, feature_run())
    return producers.withColumns({c: F.round(c, 9) for c in ("avg_features", "success_rate")})


@query(f"WITH {FEATURES_SQL}, k AS (SELECT a + b + c + d AS k, * FROM f) SELECT count(*) AS documents, count(*) FILTER (k > 0) AS successful, min(k) FILTER (k > 0) AS least, max(k) FILTER (k > 0) AS most, round(avg(k) FILTER (k > 0), 9) AS mean, max(a) + max(b) + max(c) + max(d) AS unique_features, round(count(*) FILTER (k > 0) / count(*), 9) AS success_rate FROM k")
def extraction_report(t):
    _, totals = P.feature_report(t.documents, feature_run())
    return totals.withColumns({c: F.round(c, 9) for c in ("mean", "success_rate")})


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[\x09-\x0D\x20]+', ' ', 'g')), ' ')) AS w FROM documents), b AS (SELECT doc_id, CAST(md5_number_lower(w) % 384 AS INT) AS place, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
 SELECT doc_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 8) AS weight FROM b""")
def encoded_texts(t):
    """Vectors of whole texts by the encoder that needs no model files; the places that are not 0."""
    d = E.with_vectors(t.documents.select("doc_id", "text"), E.HashedWords())
    return d.select("doc_id", F.posexplode("vector").alias("place", "weight")).where("weight <> 0").withColumn("weight", F.round("weight", 8))


SPLIT_SQL = T.split_place("doc_id").replace("AS STRING", "AS VARCHAR")


@query(f"SELECT count(*) AS total_examples, count(*) FILTER ({SPLIT_SQL} < {T.TRAINING_BELOW}) AS training_examples, count(*) FILTER ({SPLIT_SQL} >= {T.TRAINING_BELOW}) AS validation_examples FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def training_split(t):
    d = t.documents.join(t.labels.where("quality IS NOT NULL"), "doc_id").withColumn("training", T.for_training("doc_id"))
    return d.agg(F.count(F.lit(1)).alias("total_examples"), F.count_if("training").alias("training_examples"), F.count_if(~F.col("training")).alias("validation_examples"))


@query()
def training_record(t):
    """The record of a category model trained on one side of the split and scored on the other."""
    d = t.documents.join(t.labels.where("quality IS NOT NULL"), "doc_id").select("doc_id", "text", F.concat(F.lit("Q_"), F.col("quality").cast("string")).alias("category"))
    _, records = T.train_and_record(d, "doc_id", work_folder(t.spark, "records"))
    return records.drop("training_seconds")


CONFUSED_SQL = """m AS (SELECT 'Q_' || CAST(quality AS VARCHAR) AS gold, CASE WHEN n_chars > 500 THEN 'Q_1' ELSE 'Q_0' END AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT gold AS category, CAST(sum(n) AS BIGINT) AS support, coalesce(sum(n) FILTER (gold = predicted), 0) AS hits, (SELECT sum(n) FROM m x WHERE x.predicted = m.gold) AS found FROM m GROUP BY 1),
 c AS (SELECT category, support, coalesce(hits / found, 0) AS precision, hits / support AS recall FROM s), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c)"""


def confused(t):
    """A rule by length judged by the quality labels."""
    d = t.documents.join(t.labels, "doc_id").select(F.concat(F.lit("Q_"), F.col("quality").cast("string")).alias("category"), F.when(F.col("n_chars") > 500, "Q_1").otherwise("Q_0").alias("predicted"))
    return T.confusion(d)


@query(f"WITH {CONFUSED_SQL} SELECT category, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def category_scores(t):
    return T.class_scores(confused(t)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"""WITH {CONFUSED_SQL}, a AS (SELECT CAST(sum(n) AS BIGINT) AS validation_examples, sum(n) FILTER (gold = predicted) / sum(n) AS accuracy FROM m), g AS (SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM f)
 SELECT validation_examples, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, accuracy >= 0.85 AND f1 >= 0.8 AS validation_passed, CASE WHEN accuracy >= 0.95 AND f1 >= 0.9 THEN 'excellent' WHEN accuracy >= 0.85 AND f1 >= 0.8 THEN 'good' ELSE 'insufficient' END AS model_quality FROM a, g""")
def model_gate(t):
    return T.gated(T.model_scores(confused(t))).withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


def strategies(t):
    rules = rule_catalogue(t.spark, RULES)
    return {
        "rules": lambda d: R.classify_by_rules(d, rules),
        "simple": lambda d: R.classify_by_rules_simple(d, rules, BRANDS),
        "price": lambda d: d.select(F.when(F.col("price") >= 800, "0480").when(F.col("price") < 100, "4980").alias("account"), F.when(F.col("price") >= 800, 0.6).when(F.col("price") < 100, 0.7).alias("confidence")),
        "broken": lambda d: d.select("no_such_column"),
    }


RUNS_SQL = f"""{SIMPLE_SQL}, {CLASSIFIED_SQL.split(f'{RULES_SQL}, ', 1)[1].replace('per AS', 'per2 AS').replace('best AS', 'best2 AS').replace('FROM per ', 'FROM per2 ').replace('LEFT JOIN best b', 'LEFT JOIN best2 b')}, runs AS (SELECT 'rules' AS strategy, account, confidence FROM classified UNION ALL SELECT 'simple', account, confidence FROM simple UNION ALL SELECT 'price', CASE WHEN price >= 800 THEN '0480' WHEN price < 100 THEN '4980' END, CASE WHEN price >= 800 THEN 0.6 WHEN price < 100 THEN 0.7 END FROM items),
 seen AS (SELECT strategy, TRUE AS success, count(*) AS items, count(account) AS classified, count(*) FILTER (confidence IS NULL OR confidence NOT BETWEEN 0 AND 1) AS faults, avg(confidence) AS mean_confidence FROM runs GROUP BY 1)"""


@query(f"WITH {RUNS_SQL} SELECT strategy, success, items, classified, faults, round(mean_confidence, 9) AS mean_confidence FROM seen UNION ALL SELECT 'broken', FALSE, NULL, NULL, NULL, NULL")
def compared_strategies(t):
    """Strategies over one stored input, each observed while it runs."""
    return ST.compare_strategies(invoice_items(t), strategies(t)).select("strategy", "success", "items", "classified", "faults", F.round("mean_confidence", 9).alias("mean_confidence"))


@query(f"WITH {RUNS_SQL} SELECT count(*) + 1 AS tested, count(*) AS successful, (SELECT strategy FROM seen ORDER BY mean_confidence DESC, strategy LIMIT 1) AS highest_confidence, (SELECT strategy FROM seen ORDER BY classified DESC, strategy LIMIT 1) AS most_classifications FROM seen")
def strategies_summary(t):
    return ST.comparison_summary(ST.compare_strategies(invoice_items(t), strategies(t))).drop("fastest")
