"""Queries of run metrics, costs, errors, learning statistics, windows, top-k and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.running import moving_sums, running_sums
from ..sources.tables import FEEDBACK_SQL, ITEMS_SQL, METRICS_SQL, feedback, invoice_items, metrics
from .registry import query

DAYS = 7


def recent(df, days: int = DAYS):
    """Rows of the last days before the newest row."""
    return df.join(F.broadcast(df.agg(F.max("ts").alias("as_of"))), how="cross").where(F.col("ts") > F.col("as_of") - F.expr(f"INTERVAL {days} DAYS"))


RECENT_SQL = f"{METRICS_SQL}, recent AS (SELECT * FROM metrics WHERE ts > (SELECT max(ts) FROM metrics) - INTERVAL {DAYS} DAY)"


@query(f"WITH {RECENT_SQL} SELECT count(*) AS n, round(avg(time_ms), 9) AS time_ms, round(avg(confidence), 12) AS confidence, round(avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END), 12) AS hit_rate, round(sum(cost), 6) AS cost, round(1 - avg(CASE WHEN error THEN 1.0 ELSE 0.0 END), 12) AS success_rate, round((5 - avg(cost)) * count(*), 6) AS savings FROM recent")
def business_metrics(t):
    m = recent(metrics(t))
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("time_ms"), 9).alias("time_ms"), F.round(F.avg("confidence"), 12).alias("confidence"), F.round(F.avg(F.col("cache_hit").cast("double")), 12).alias("hit_rate"), F.round(F.sum("cost"), 6).alias("cost"), F.round(1 - F.avg(F.col("error").cast("double")), 12).alias("success_rate"), F.round((5 - F.avg("cost")) * F.count(F.lit(1)), 6).alias("savings"))


MBAND = "CASE WHEN confidence >= 0.9 THEN 'excellent' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.65 THEN 'good' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'poor' END"


@query(f"WITH {METRICS_SQL} SELECT {MBAND} AS quality, count(*) AS n FROM metrics GROUP BY 1")
def quality_distribution(t):
    return metrics(t).groupBy(S.quality_band(F.col("confidence")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RECENT_SQL}, a AS (SELECT avg(confidence) AS c, avg(cost) AS k, avg(CASE WHEN error THEN 1.0 ELSE 0.0 END) AS e FROM recent) SELECT round_even(c * 100, 0) AS confidence_percent, round(5 / k, 6) AS roi, round(92 - c * 100, 6) AS target_gap, CASE WHEN c < 0.5 THEN 'improve accuracy' WHEN e > 0.2 THEN 'reduce errors' ELSE 'on target' END AS insight FROM a")
def business_dashboard(t):
    a = recent(metrics(t)).agg(F.avg("confidence").alias("c"), F.avg("cost").alias("k"), F.avg(F.col("error").cast("double")).alias("e"))
    return a.select(F.bround(F.col("c") * 100, 0).alias("confidence_percent"), F.round(F.try_divide(F.lit(5.0), F.col("k")), 6).alias("roi"), F.round(92 - F.col("c") * 100, 6).alias("target_gap"), F.when(F.col("c") < 0.5, "improve accuracy").when(F.col("e") > 0.2, "reduce errors").otherwise("on target").alias("insight"))


@query("SELECT props AS message, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, message LIMIT 10")
def top_errors(t):
    return t.events.where("event_type = 'error'").groupBy(F.col("props").alias("message")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message").limit(10)


@query(f"WITH {METRICS_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(CASE WHEN error THEN 1.0 ELSE 0.0 END), 12) AS error_rate FROM metrics GROUP BY 1")
def daily_error_rate(t):
    return metrics(t).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("error").cast("double")), 12).alias("error_rate"))


@query(f"WITH {METRICS_SQL}, p AS (SELECT kind AS source, avg(confidence) AS c, avg(time_ms) AS t, sum(cost) AS k, count(*) AS n FROM metrics GROUP BY 1) SELECT source, round(c, 9) AS confidence, round(t, 6) AS time_ms, round(k, 6) AS cost, n, round(n / (t / 1000), 4) AS items_per_s, round(k / n, 8) AS cost_per_item, concat_ws(',', CASE WHEN c < 0.6 THEN 'accuracy' END, CASE WHEN t > 500 THEN 'speed' END) AS recommendations FROM p")
def source_comparison(t):
    p = metrics(t).groupBy(F.col("kind").alias("source")).agg(F.avg("confidence").alias("c"), F.avg("time_ms").alias("t"), F.sum("cost").alias("k"), F.count(F.lit(1)).alias("n"))
    return p.select("source", F.round("c", 9).alias("confidence"), F.round("t", 6).alias("time_ms"), F.round("k", 6).alias("cost"), "n", F.round(F.try_divide(F.col("n"), F.col("t") / 1000), 4).alias("items_per_s"), F.round(F.try_divide("k", "n"), 8).alias("cost_per_item"), F.concat_ws(",", F.when(F.col("c") < 0.6, "accuracy"), F.when(F.col("t") > 500, "speed")).alias("recommendations"))


@query(f"WITH {METRICS_SQL} SELECT kind AS service, round(coalesce(sum(cost) FILTER (CAST(ts AS DATE) = DATE '2024-01-15'), sum(cost)), 6) AS cost FROM metrics GROUP BY 1")
def daily_service_cost(t):
    day = F.to_date("ts") == F.lit("2024-01-15").cast("date")
    return metrics(t).groupBy(F.col("kind").alias("service")).agg(F.round(F.coalesce(F.sum(F.when(day, F.col("cost"))), F.sum("cost")), 6).alias("cost"))


@query(f"WITH {FEEDBACK_SQL}, r AS (SELECT * FROM feedback WHERE ts > (SELECT max(ts) FROM feedback) - INTERVAL 10 DAY) SELECT (SELECT count(*) FROM feedback) AS total, (SELECT count(*) FROM feedback WHERE kind = 'correction') AS corrections, (SELECT count(DISTINCT account) FROM feedback) AS accounts, round((SELECT avg(CASE WHEN kind = 'confirmation' THEN 1.0 ELSE 0.0 END) FROM r), 12) AS recent_accuracy")
def learning_stats(t):
    f = feedback(t)
    r = recent(f, 10).agg(F.round(F.avg((F.col("kind") == "confirmation").cast("double")), 12).alias("recent_accuracy"))
    return f.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "correction").alias("corrections"), F.countDistinct("account").alias("accounts")).join(F.broadcast(r), how="cross")


@query(f"WITH {FEEDBACK_SQL} SELECT account AS from_account, kind, count(*) AS n FROM feedback WHERE kind = 'correction' GROUP BY 1, 2 ORDER BY n DESC, from_account LIMIT 5")
def top_corrections(t):
    return feedback(t).where(F.col("kind") == "correction").groupBy(F.col("account").alias("from_account"), "kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_account").limit(5)


@query(f"WITH {FEEDBACK_SQL}, p AS (SELECT user_id, account, count(*) AS n FROM feedback WHERE kind = 'correction' GROUP BY 1, 2) SELECT user_id, count(*) AS accounts, count(*) > 3 AS conflict, arg_max(account, (n, account)) AS recommended FROM p GROUP BY 1")
def conflict_analysis(t):
    p = feedback(t).where(F.col("kind") == "correction").groupBy("user_id", "account").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("accounts"), (F.count(F.lit(1)) > 3).alias("conflict"), F.max_by("account", F.struct("n", "account")).alias("recommended"))


@query(f"WITH {ITEMS_SQL} SELECT supplier, count(*) AS n, array_to_string(list_sort(list(DISTINCT account)), ',') AS accounts, round(avg(rate), 12) AS rate FROM items GROUP BY 1")
def context_statistics(t):
    return invoice_items(t).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("account")), ",").alias("accounts"), F.round(F.avg("rate"), 12).alias("rate"))


@query(f"WITH {METRICS_SQL} SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) AS INT) AS hour, count(*) AS n, round(sum(time_ms), 4) AS time_ms, round(avg(confidence), 12) AS confidence, count(*) FILTER (confidence > 0.8) AS high, count(*) FILTER (confidence < 0.5) AS low FROM metrics GROUP BY 1, 2, 3")
def hourly_facts(t):
    return metrics(t).groupBy("user_id", F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("time_ms"), 4).alias("time_ms"), F.round(F.avg("confidence"), 12).alias("confidence"), F.count_if(F.col("confidence") > 0.8).alias("high"), F.count_if(F.col("confidence") < 0.5).alias("low"))


@query(f"WITH {ITEMS_SQL}, c AS (SELECT supplier, account, count(*) AS n FROM items GROUP BY 1, 2) SELECT supplier, account, n, round(n / sum(n) OVER (PARTITION BY supplier), 9) AS probability FROM c")
def supplier_profiles(t):
    c = invoice_items(t).groupBy("supplier", "account").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("supplier")), 9))


@query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 6) AS saved, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2")
def warming_analytics(t):
    return t.events.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("saved"), F.round(F.avg("value"), 8).alias("mean"))


@query("""WITH g AS (SELECT user_id, count(*) AS f, avg(value) AS saved, max(ts) AS last FROM events GROUP BY 1 HAVING count(*) >= 2), a AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, f, 0.4 * f + 0.3 * (1.0 / (1 + user_id % 5)) + 0.2 * saved + 0.1 * greatest(0, 30 - date_diff('day', CAST(last AS DATE), CAST(now AS DATE))) AS score FROM g, a)
 SELECT user_id, f AS frequency, round(score, 8) AS score, CASE WHEN score > 50 THEN 'now' WHEN score > 20 THEN 'soon' ELSE 'later' END AS advice FROM s""")
def warming_recommendations(t):
    g = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("frequency"), F.avg("value").alias("saved"), F.max("ts").alias("last")).where("frequency >= 2")
    g = g.join(F.broadcast(t.events.agg(F.max("ts").alias("now"))), how="cross")
    score = 0.4 * F.col("frequency") + 0.3 * (1.0 / (1 + F.col("user_id") % 5)) + 0.2 * F.col("saved") + 0.1 * F.greatest(F.lit(0), 30 - F.datediff("now", "last"))
    return g.select("user_id", "frequency", F.round(score, 8).alias("score"), F.when(score > 50, "now").when(score > 20, "soon").otherwise("later").alias("advice"))


@query("SELECT user_id, count(*) AS hits, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def running_counters(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 8) AS mean, max(value) AS most FROM events GROUP BY 1")
def invalidation_statistics(t):
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 8).alias("mean"), F.max("value").alias("most"))


@query("WITH a AS (SELECT max(ts) AS now FROM events) SELECT count(*) AS n, CAST(min(ts) AS VARCHAR)[1:19] AS oldest, CAST(max(ts) AS VARCHAR)[1:19] AS newest, round(avg(date_diff('day', CAST(ts AS DATE), CAST(now AS DATE))), 9) AS age_days, CASE WHEN count(*) > 1000 THEN 'full' ELSE 'ok' END AS usage, count(*) FILTER (ts > now - INTERVAL 24 HOUR) AS last_day FROM events, a")
def cache_health(t):
    e = t.events.join(F.broadcast(t.events.agg(F.max("ts").alias("now"))), how="cross")
    return e.agg(F.count(F.lit(1)).alias("n"), F.substring(F.min("ts").cast("string"), 1, 19).alias("oldest"), F.substring(F.max("ts").cast("string"), 1, 19).alias("newest"), F.round(F.avg(F.datediff("now", "ts")), 9).alias("age_days"), F.when(F.count(F.lit(1)) > 1000, "full").otherwise("ok").alias("usage"), F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS")).alias("last_day"))


@query("SELECT event_type, round(avg(value), 8) AS mean, round(median(value), 8) AS median, min(value) AS low, max(value) AS high, round(stddev_samp(value), 8) AS deviation, round(60000 / avg(value * 10), 6) AS per_minute FROM events GROUP BY 1")
def benchmark_stats(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 8).alias("mean"), F.round(F.median("value"), 8).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.stddev_samp("value"), 8).alias("deviation"), F.round(60000 / F.avg(F.col("value") * 10), 6).alias("per_minute"))


@query("SELECT count(DISTINCT o_orderkey) AS documents, count(l_orderkey) AS classifications, round(count(l_orderkey) / count(DISTINCT o_orderkey), 9) AS per_document FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def analyze_results(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    d = t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return d.agg(F.countDistinct("o_orderkey").alias("documents"), F.sum(F.coalesce("k", F.lit(0))).alias("classifications")).withColumn("per_document", F.round(F.col("classifications") / F.col("documents"), 9))


@query(f"WITH {METRICS_SQL} SELECT user_id % 10 AS batch, count(*) FILTER (NOT error) AS ok, count(*) FILTER (error) AS failed, round(avg(time_ms), 9) AS time_ms, round(avg(CASE WHEN error THEN 0.0 ELSE 1.0 END), 12) AS success_rate, concat_ws(',', CASE WHEN avg(confidence) < 0.5 THEN 'efficiency' END, CASE WHEN avg(time_ms) > 500 THEN 'time' END, CASE WHEN avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END) < 0.3 THEN 'hit rate' END) AS insights FROM metrics GROUP BY 1")
def batch_metrics(t):
    return metrics(t).groupBy((F.col("user_id") % 10).alias("batch")).agg(F.count_if(~F.col("error")).alias("ok"), F.count_if("error").alias("failed"), F.round(F.avg("time_ms"), 9).alias("time_ms"), F.round(F.avg((~F.col("error")).cast("double")), 12).alias("success_rate"), F.concat_ws(",", F.when(F.avg("confidence") < 0.5, "efficiency"), F.when(F.avg("time_ms") > 500, "time"), F.when(F.avg(F.col("cache_hit").cast("double")) < 0.3, "hit rate")).alias("insights"))


@query(f"WITH {METRICS_SQL} SELECT user_id, round(coalesce(avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END), 0), 9) AS hit_ratio, round(sum(cost) / greatest(1, count(*) FILTER (NOT error)), 8) AS cost_per_success FROM metrics GROUP BY 1")
def hit_ratio_and_api_cost(t):
    return metrics(t).groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.col("cache_hit").cast("double")), F.lit(0.0)), 9).alias("hit_ratio"), F.round(F.sum("cost") / F.greatest(F.lit(1), F.count_if(~F.col("error"))), 8).alias("cost_per_success"))


@query("SELECT 'documents' AS dataset, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'orders', count(*) FROM orders")
def training_stats(t):
    def n(name, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dataset"), "n")

    return n("documents", t.documents).unionByName(n("labels", t.labels)).unionByName(n("orders", t.orders))


@query(f"WITH {FEEDBACK_SQL}, g AS (SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT account) AS accounts, avg(CASE WHEN kind = 'confirmation' THEN 1.0 ELSE 0.0 END) AS a FROM feedback) SELECT CASE WHEN n > 1000 AND a < 0.5 THEN 'critical' WHEN n > 100 THEN 'high' ELSE 'low' END AS priority, a >= 0.85 AS accurate, concat_ws(',', CASE WHEN n < 50 THEN 'more feedback' END, CASE WHEN users < 10 THEN 'more suppliers' END, CASE WHEN accounts < 15 THEN 'more accounts' END) AS recommendations FROM g")
def training_priority(t):
    g = feedback(t).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("account").alias("accounts"), F.avg((F.col("kind") == "confirmation").cast("double")).alias("a"))
    return g.select(F.when((F.col("n") > 1000) & (F.col("a") < 0.5), "critical").when(F.col("n") > 100, "high").otherwise("low").alias("priority"), (F.col("a") >= 0.85).alias("accurate"), F.concat_ws(",", F.when(F.col("n") < 50, "more feedback"), F.when(F.col("users") < 10, "more suppliers"), F.when(F.col("accounts") < 15, "more accounts")).alias("recommendations"))


@query("SELECT event_id, user_id, lag(props) OVER w IS DISTINCT FROM props AS changed, CASE WHEN lag(value) OVER w IS NULL THEN 'baseline' WHEN abs(value - lag(value) OVER w) > 0.1 * lag(value) OVER w THEN 'severe' WHEN value = lag(value) OVER w THEN 'no_changes' ELSE 'changes' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def change_detection(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("value").over(w)
    return t.events.select("event_id", "user_id", (~F.lag("props").over(w).eqNullSafe(F.col("props"))).alias("changed"), F.when(before.isNull(), "baseline").when(F.abs(F.col("value") - before) > 0.1 * before, "severe").when(F.col("value") == before, "no_changes").otherwise("changes").alias("state"))


@query("WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_chars AS before, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents) SELECT source, count(*) FILTER (total - before > 20000) AS evicted, coalesce(sum(n_chars) FILTER (total - before <= 20000), 0) AS kept_chars FROM r GROUP BY 1")
def evict_oldest(t):
    r = running_sums(t.documents.select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", total="total")
    out = F.col("total") - F.col("before") > 20000
    return r.groupBy("source").agg(F.count_if(out).alias("evicted"), F.coalesce(F.sum(F.when(~out, F.col("n_chars"))), F.lit(0)).alias("kept_chars"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS hour_cost, sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) <= 500 AS within FROM events")
def rolling_hour_cost(t):
    e = t.events.select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    s = moving_sums(e, ["event_type"], "us", 3_600_000_000, "value")
    return s.select("event_id", F.round("moving", 6).alias("hour_cost"), (F.col("moving") <= 500).alias("within"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS recent_mean FROM events")
def recent_batch_mean(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return t.events.select("event_id", F.round(F.avg("value").over(w), 8).alias("recent_mean"))


@query("SELECT event_id, CASE WHEN coalesce(sum(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5000 THEN 'remote' ELSE 'local' END AS route FROM events")
def budget_routing(t):
    e = t.events.select("event_id", "ts", "value", F.to_date("ts").alias("day"))
    return running_sums(e, ["day"], ["ts", "event_id"], "value").select("event_id", F.when(F.col("before") < 5000, "remote").otherwise("local").alias("route"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_partkey FROM lineitem")
def position_numbering(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select("l_orderkey", F.row_number().over(w).alias("pos"), "l_partkey")


@query("SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) / 10) AS BIGINT) AS batch FROM documents")
def adaptive_batches(t):
    d = t.documents.select("source", "doc_id", "n_chars")
    return running_sums(d, ["source"], [F.desc("n_chars"), "doc_id"], F.lit(1)).select("source", "doc_id", F.floor(F.col("before") / 10).alias("batch"))


@query("SELECT event_id, value, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_points(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "value", "event_type")


@query(f"WITH {ITEMS_SQL} SELECT supplier, count(*) AS n, round(sum(net), 2) AS net FROM items GROUP BY 1 ORDER BY n DESC, supplier LIMIT 10")
def top_suppliers(t):
    return invoice_items(t).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 2).alias("net")).orderBy(F.desc("n"), "supplier").limit(10)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def top_three_per_user(t):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return t.events.withColumn("r", r).where("r <= 3").select("user_id", "event_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def distinct_documents(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT doc_id, 'ner' AS kind, CAST(n_chars AS BIGINT) AS size, NULL AS label FROM documents WHERE contains(text, '@') UNION ALL SELECT doc_id, 'cat', NULL, quality FROM labels")
def annotation_union(t):
    a = t.documents.where(F.col("text").contains("@")).select("doc_id", F.lit("ner").alias("kind"), F.col("n_chars").alias("size"))
    return a.unionByName(t.labels.select("doc_id", F.lit("cat").alias("kind"), F.col("quality").alias("label")), allowMissingColumns=True)


@query("SELECT DISTINCT unnest(json_keys(props)) AS feature FROM events")
def feature_name_union(t):
    return t.events.select(F.explode(F.json_object_keys("props")).alias("feature")).distinct()


AGE = "ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY"


@query(f"SELECT event_id, {AGE} AS kept FROM events")
def retention_by_age(t):
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(now), how="cross").select("event_id", (F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")).alias("kept"))


@query(f"WITH {METRICS_SQL}, s AS (SELECT avg(CASE WHEN confidence < 0.3 THEN 1.0 ELSE 0.0 END) AS share FROM metrics) SELECT run_id FROM metrics, s WHERE NOT (share > 0.2 AND confidence < 0.7)")
def retention_by_quality(t):
    m = metrics(t)
    share = m.agg(F.avg((F.col("confidence") < 0.3).cast("double")).alias("share"))
    return m.join(F.broadcast(share), how="cross").where(~((F.col("share") > 0.2) & (F.col("confidence") < 0.7))).select("run_id")


@query(f"WITH {METRICS_SQL} SELECT run_id FROM metrics WHERE ts > (SELECT max(ts) FROM metrics) - INTERVAL 20 DAY AND confidence >= 0.6")
def retention_optimized(t):
    m = metrics(t)
    return m.join(F.broadcast(m.agg(F.max("ts").alias("now"))), how="cross").where((F.col("ts") > F.col("now") - F.expr("INTERVAL 20 DAYS")) & (F.col("confidence") >= 0.6)).select("run_id")


@query(f"WITH r AS (SELECT *, sum(value) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size FROM events WHERE {AGE}) SELECT event_id FROM r WHERE size <= 0.8 * 10000")
def emergency_cleanup(t):
    now = t.events.agg(F.max("ts").alias("now"))
    young = t.events.join(F.broadcast(now), how="cross").where(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")).select("event_id", "event_type", "ts", "value")
    return running_sums(young, ["event_type"], [F.desc("ts"), F.desc("event_id")], "value").where("before + value <= 0.8 * 10000").select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'")
def retention_by_version(t):
    return t.events.where(F.get_json_object("props", "$.k") == "3").select("event_id")
