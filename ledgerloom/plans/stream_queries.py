"""Queries that run the streaming jobs over the events table to its end, and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.scratch import stored, work_folder
from ..sources.tables import invoice_items
from ..streaming import patterns as SP
from ..streaming import streams as ST
from ..streaming.seen import SeenIndex, dedupe_stream
from ..streaming.store import BucketStore, upsert_stream
from .account_queries import PATTERNS_SQL, RETURNED_SQL
from .registry import query

# In append mode windows stay open until the watermark passes their end.
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def waves(t):
    """All events, to arrive in waves by their time."""
    return ST.time_waves(t.events.withColumn("ts", F.col("ts").cast("timestamp")))


@query(f"SELECT CAST(date_trunc('hour', ts) AS VARCHAR)[1:19] AS start, event_type, count(*) AS n, round(avg(value), 8) AS mean FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED} GROUP BY 1, 2")
def stream_tumbling_metrics(t):
    out = ST.through_restarts(waves(t), ST.tumbling_metrics)
    return out.select(F.substring(F.col("start").cast("string"), 1, 19).alias("start"), "event_type", "n", F.round("mean", 8).alias("mean"))


@query(f"""WITH w AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 300 * 300 - 300 * k AS s, value FROM events, range(12) AS r(k)), g AS (SELECT s, sum(value) AS cost FROM w GROUP BY 1) SELECT s AS start_s, round(cost, 6) AS cost, cost <= 1000 AS within FROM g WHERE s + 3600 <= epoch({CLOSED})""")
def stream_sliding_cost(t):
    out = ST.through_restarts(waves(t), lambda e: ST.sliding_cost(e, 1000.0))
    return out.select(F.unix_timestamp("start").alias("start_s"), F.round("cost", 6).alias("cost"), "within")


# Every tenth event arrives a wave late; what arrives after its hour was closed, an hour after it by the newest event so far, is set apart.
ARRIVALS_SQL = """span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), arrived AS (SELECT *, least(2, 3 * (epoch_us(ts) - lo) // (hi - lo + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS wave FROM events, span),
 marks AS (SELECT w, (SELECT max(ts) FROM arrived WHERE wave < w) AS newest FROM range(3) AS r(w)), judged AS (SELECT a.*, date_trunc('hour', ts) AS start, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= newest - INTERVAL 1 HOUR, FALSE) AS late FROM arrived a JOIN marks ON w = wave)"""


def late_arrivals(t):
    late = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    w = waves(t)
    return w.withColumn("wave", F.least(F.lit(ST.WAVES - 1), F.col("wave") + late))


@query(f"WITH {ARRIVALS_SQL} SELECT CAST(start AS VARCHAR)[1:19] AS start, event_type, count(*) AS n, round(avg(value), 8) AS mean, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) AS error_rate FROM judged WHERE NOT late GROUP BY 1, 2")
def stream_partial_metrics(t):
    """Hourly metrics merged from the sums of every batch, without what came too late."""
    folder = ST.through_restarts(late_arrivals(t), lambda e: e, sink=ST.tumbling_partials)
    out = ST.merged_partials(t.spark, folder)
    return out.select(F.substring(F.col("start").cast("string"), 1, 19).alias("start"), "event_type", "n", F.round("mean", 8).alias("mean"), F.round("error_rate", 9).alias("error_rate"))


@query(f"WITH {ARRIVALS_SQL} SELECT event_id, user_id, event_type, value, props FROM judged WHERE late")
def stream_late_events(t):
    """The events that stream_partial_metrics sets apart, whole."""
    folder = ST.through_restarts(late_arrivals(t), lambda e: e, sink=ST.tumbling_partials)
    return t.spark.read.schema(ST.EVENTS).parquet(f"{folder}/late").select("event_id", "user_id", "event_type", "value", "props")


@query("SELECT user_id, json_extract_string(props, '$.k') AS account, count(*) AS n, round(least(0.3, 0.05 * count(*)), 6) AS boost, arg_min(value, (ts, event_id)) AS first_price FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def stream_learned_patterns(t):
    out = ST.latest(ST.through_restarts(waves(t), ST.learned_patterns, "update"), ["user_id", "account"])
    return out.select("user_id", "account", "n", F.round("boost", 6).alias("boost"), "first_price")


@query(f"WITH {RETURNED_SQL}, {PATTERNS_SQL.replace('count(*) AS n', 'count(*) AS n, max(shipped) AS newest')} SELECT supplier, account, d AS description, n, round(boost, 4) AS boost, round(0.8 * first_price, 8) AS price_min, round(1.2 * first_price, 8) AS price_max, CAST(newest AS VARCHAR)[1:10] AS last_updated FROM patterns")
def stream_keyed_patterns(t):
    """returned_patterns from a stream of every returned line, by keyed state that outlives restarts."""
    lines = invoice_items(t, t.lineitem.where("l_returnflag = 'R'")).select(*SP.KEYS, "price", F.col("shipped").cast("timestamp").alias("ts"), "invoice_id", "position", "l_partkey", "net")
    lines = stored(lines, "lines")  # each wave reads them again
    with SP.keyed_state(t.spark):
        written = ST.through_restarts(ST.time_waves(lines), lambda s: SP.keyed_patterns(s, ["ts_us", "invoice_id", "position", "l_partkey", "net"]), "update")
    p = ST.latest(written, SP.KEYS)
    return p.select(*SP.KEYS, "n", F.round("boost", 4).alias("boost"), F.round("price_min", 8).alias("price_min"), F.round("price_max", 8).alias("price_max"), F.substring(F.col("last_updated").cast("string"), 1, 10).alias("last_updated"))


@query("SELECT DISTINCT sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || props) AS hash FROM events WHERE sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || props) NOT IN (SELECT sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || props) FROM events WHERE event_id % 2 = 0)")
def stream_new_contents(t):
    return first_contents(t).select("hash")


CONTENT_SQL = "sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || props)"


@query(f"WITH h AS (SELECT *, {CONTENT_SQL} AS hash, 3 * (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) // ((SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events) + 1) AS wave FROM events) SELECT event_id, user_id, event_type, value, hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE event_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY wave, ts, event_id) = 1")
def stream_first_events(t):
    """The first event of each content that is not among those stored before, whole."""
    return first_contents(t).select("event_id", "user_id", "event_type", "value", "hash")


def first_contents(t):
    content = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256).alias("hash")
    found = []

    def sink(stream, folder):
        index = SeenIndex(t.spark, f"{folder}/seen")
        if not found:
            index.add(t.events.where("event_id % 2 = 0").select(content).distinct(), -1)
        dedupe_stream(stream, index, ["ts", "event_id"], folder)
        found.append(t.spark.read.schema(stream.schema).parquet(f"{folder}/out"))

    ST.through_restarts(waves(t), lambda e: e.select("*", content), sink=sink)
    return found[-1]


def stored_newest(t):
    """A store with the newest event of every user, merged from a stream."""
    stores = []

    def sink(stream, folder):
        stores.append(BucketStore(t.spark, f"{folder}/store", "user_id", ["ts", "event_id"]))
        upsert_stream(stream, stores[-1], f"{folder}/log")

    ST.through_restarts(waves(t), lambda e: e, sink=sink)
    return stores[-1].read()


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_upsert(t):
    return stored_newest(t).select("user_id", "event_type")


@query("SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value, props FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_newest_events(t):
    """Whole rows from the store, whose batches rewrite only the buckets that they touch."""
    return stored_newest(t).select("user_id", "event_id", F.unix_micros("ts").alias("us"), "event_type", "value", "props")


@query(f"WITH d AS (SELECT date_trunc('day', ts) AS s, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1) SELECT CAST(s AS VARCHAR)[1:10] AS start, round(rate, 9) AS rate FROM d WHERE rate < 0.8 AND s + INTERVAL 1 DAY <= {CLOSED}")
def stream_success_alerts(t):
    out = ST.through_restarts(waves(t), lambda e: ST.success_alerts(e, 0.8))
    return out.select(F.substring(F.col("start").cast("string"), 1, 10).alias("start"), F.round("rate", 9).alias("rate"))


@query(f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER u + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT CAST(min(ts) AS VARCHAR)[1:19] AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def stream_sessions(t):
    return ST.through_restarts(waves(t), ST.sessions).withColumn("start", F.substring(F.col("start").cast("string"), 1, 19))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def json_round_trip(t):
    path = work_folder(t.spark)
    t.documents.write.json(path)
    good, _ = files.read_results(t.spark, path, t.documents.schema)
    return good.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT account, p_type AS category, p_partkey FROM (SELECT '3' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS account, p_type, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY account ORDER BY p_partkey DESC) = 1")
def chart_of_accounts(t):
    path = work_folder(t.spark)
    p = t.part.select(F.concat(F.lit(" 3"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("account"), F.col("p_type").alias("category"), "p_partkey")
    p.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").write.option("sep", ";").option("header", True).csv(path)
    read = t.spark.read.option("sep", ";").option("header", True).csv(path).withColumn("account", F.trim("account")).withColumn("p_partkey", F.col("p_partkey").cast("long"))
    return files.latest_per_key(read, "account", "p_partkey", "category")


@query("SELECT count(*) AS total, count(*) AS inserted, 1.0 AS success_rate FROM embeddings")
def bulk_insert(t):
    return files.insert_with_summary(t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label"), work_folder(t.spark))


@query("SELECT 'Q_' || CAST(quality AS VARCHAR) AS cat, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def training_files(t):
    path = work_folder(t.spark)
    d = t.documents.join(t.labels.where("quality IS NOT NULL"), "doc_id")
    cats = F.create_map(F.concat(F.lit("Q_"), F.col("quality").cast("string")), F.lit(1.0))
    files.write_examples(d.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(cats.alias("cats")).alias("annotations")), path)
    return files.read_category_examples(t.spark, path).groupBy(F.get(F.map_keys("annotations.cats"), F.lit(0)).alias("cat")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, 'Q_' || CAST(quality AS VARCHAR) AS cat FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def training_texts(t):
    """Whole texts with their categories, written as JSON lines and read back."""
    path = work_folder(t.spark)
    d = t.documents.join(t.labels.where("quality IS NOT NULL"), "doc_id")
    cats = F.create_map(F.concat(F.lit("Q_"), F.col("quality").cast("string")), F.lit(1.0))
    d.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), F.struct(cats.alias("cats")).alias("annotations")).write.json(path)
    back = t.spark.read.schema("doc_id long, lang string, text string, annotations struct<cats: map<string, double>>").json(path)
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", F.get(F.map_keys("annotations.cats"), F.lit(0)).alias("cat"))


@query("SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents")
def json_documents(t):
    """Whole documents, written as JSON and read back by their schema."""
    path = work_folder(t.spark)
    t.documents.write.json(path)
    good, _ = files.read_results(t.spark, path, t.documents.schema)
    return good.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


@query("SELECT p_type AS category, string_agg(DISTINCT account, ',' ORDER BY account) AS accounts FROM (SELECT '3' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS account, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) = 1) GROUP BY 1")
def accounts_by_category(t):
    """The accounts of each category, from a chart read from its text form."""
    path = work_folder(t.spark)
    p = t.part.select(F.concat(F.lit(" 3"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("account"), F.col("p_type").alias("category"), "p_partkey")
    p.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").write.option("sep", ";").option("header", True).csv(path)
    chart = files.read_chart(t.spark, path)
    return files.accounts_by_category(chart.withColumn("p_partkey", F.col("p_partkey").cast("long"))).withColumn("accounts", F.array_join("accounts", ","))


@query("SELECT s_name AS name FROM supplier")
def supplier_names(t):
    path = work_folder(t.spark)
    t.supplier.select(F.explode(F.array(F.lit("# supplier"), F.lit(""), F.col("s_name"))).alias("value")).write.text(path)
    return files.read_names(t.spark, path)
