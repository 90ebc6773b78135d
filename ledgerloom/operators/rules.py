"""Account assignment: keyword rules, neighbour votes, their combination, context and feedback."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, valid_account
from .scan import MAX_LITERALS, contained

FALLBACK_ACCOUNT = "3400"


#: A keyword between other characters than letters and digits.
BOUND = "(^|[^a-z0-9])", "([^a-z0-9]|$)"


def keyword_hits(items: DataFrame, rules: DataFrame, text: str = "description", supplier: str = "supplier") -> DataFrame:
    """(text, supplier, category, ...) a row per keyword that a distinct text contains.

    Texts are made distinct first. All keywords are found in one pass over a
    text by an automaton; a catalogue beyond MAX_LITERALS keywords is joined by
    a nested loop instead.
    """
    texts = items.select(F.col(text).alias("_text"), F.col(supplier).alias("_supplier")).distinct()
    texts = texts.withColumn("_low", F.lower("_text"))
    keywords = [r.keyword for r in rules.select("keyword").where("keyword <> ''").distinct().limit(MAX_LITERALS + 1).collect()]
    if len(keywords) <= MAX_LITERALS:
        found = contained(texts, "_low", keywords, "_found").select("*", F.explode("_found").alias("_number")).drop("_found")
        numbered = items.sparkSession.createDataFrame(list(enumerate(keywords)), "_number int, keyword string")
        hit = found.join(rules.join(numbered, "keyword"), "_number").drop("_number")
    else:
        hit = texts.join(rules, F.col("_low").contains(F.col("keyword")))
    word = F.concat(F.lit(BOUND[0]), F.regexp_replace("keyword", r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(BOUND[1]))
    sup = F.coalesce(F.lower("_supplier"), F.lit(""))
    return hit.withColumn("whole", F.regexp_like("_low", word)).withColumn("by_supplier", sup.contains(F.col("keyword"))).drop("_low")


#: A catalogue of so many keywords at most is written into the plan; a larger one is joined.
MAX_IN_PLAN = 300


def _in_row(items: DataFrame, entries: list, text: str, supplier: str, bonuses: bool = True) -> DataFrame:
    """items with _r, the best category of each row by catalogue order: plain expressions, without a join or a shuffle.

    A keyword weighs 1 and a tenth of its length; bonuses are given for whole
    words and for keywords in the supplier's name.
    """
    low, sup = F.lower(F.col(text)), F.coalesce(F.lower(F.col(supplier)), F.lit(""))
    d = items.withColumns({"_low": low, "_sup": sup, "_padded": F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]", " "), F.lit(" "))})
    categories: dict[int, list] = {}
    for r in sorted(entries, key=lambda r: (r.cat_ord, r.kw_ord)):
        categories.setdefault(r.cat_ord, []).append(r)

    def hit(r) -> Column:
        return F.coalesce(F.contains(F.col("_low"), F.lit(r.keyword)), F.lit(False))

    def score(r) -> Column:
        if not bonuses:
            return F.when(hit(r), F.lit(1 + 0.1 * len(r.keyword))).otherwise(0.0)
        if re.fullmatch("[a-z0-9]+", r.keyword):
            whole = F.contains(F.col("_padded"), F.lit(f" {r.keyword} "))
        else:
            whole = F.regexp_like(F.col("_low"), F.lit(BOUND[0] + re.escape(r.keyword) + BOUND[1]))
        return F.when(hit(r), F.lit(1 + 0.1 * len(r.keyword)) + F.when(F.contains(F.col("_sup"), F.lit(r.keyword)), 2.0).otherwise(0.0) + F.when(whole, 0.5).otherwise(0.0)).otherwise(0.0)

    scores = [F.struct(reduce(add, map(score, rows)).alias("score"), F.lit(-k).alias("order")) for k, rows in categories.items()]
    d = d.withColumn("_top", F.array_max(F.array(*scores)))
    best = F.lit(None).cast("struct<category: string, account: string, score: double, matches: bigint, keywords: array<string>>")
    for k, rows in categories.items():
        words = F.array_compact(F.array(*(F.when(hit(r), F.lit(r.keyword)) for r in rows)))
        own = F.struct(F.lit(rows[0].category).alias("category"), F.lit(rows[0].account).cast("string").alias("account"), F.col("_top.score").alias("score"), F.size(words).cast("long").alias("matches"), words.alias("keywords"))
        best = F.when((F.col("_top.order") == -k) & (F.col("_top.score") > 0), own).otherwise(best)
    return d.withColumn("_r", best).drop("_low", "_sup", "_padded", "_top")


def _best(hits: DataFrame, score: Column) -> DataFrame:
    per = hits.groupBy("_text", "_supplier", "cat_ord", "category", "account").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("matches"), F.transform(F.sort_array(F.collect_list(F.struct("kw_ord", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    best = per.groupBy("_text", "_supplier").agg(F.max_by(F.struct("category", "account", "score", "matches", "keywords"), F.struct("score", -F.col("cat_ord"))).alias("r"))
    return best.select("_text", "_supplier", "r.*")


def classify_by_rules(items: DataFrame, rules: DataFrame, default_category: str = "default", text: str = "description", supplier: str = "supplier") -> DataFrame:
    """items with category, account, confidence, keywords of the best category.

    The first category in catalogue order wins ties. Without a hit: the default
    category, the fallback account, confidence .2 and no keywords.
    """
    rest = items.drop("category", "account", "confidence", "keywords")
    entries = rules.select("cat_ord", "kw_ord", "category", "account", "keyword").limit(MAX_IN_PLAN + 1).collect()
    if 0 < len(entries) <= MAX_IN_PLAN:
        out = _in_row(rest, entries, text, supplier).select(*rest.columns, "_r.*")
    else:
        score = 1 + 0.1 * F.length("keyword") + F.when(F.col("by_supplier"), 2.0).otherwise(0.0) + F.when(F.col("whole"), 0.5).otherwise(0.0)
        best = _best(keyword_hits(items, rules, text, supplier), score)
        out = rest.join(best, F.col(text).eqNullSafe(F.col("_text")) & F.col(supplier).eqNullSafe(F.col("_supplier")), "left").drop("_text", "_supplier")
    confidence = F.when(F.col("score").isNull(), 0.2).otherwise(F.least(F.lit(0.8), 0.3 + 0.05 * F.col("score")) + F.least(F.lit(0.15), 0.03 * F.col("matches")))
    account = F.when(F.coalesce(valid_account(F.col("account")), F.lit(False)), F.col("account")).otherwise(FALLBACK_ACCOUNT)
    return out.withColumns({"category": F.coalesce("category", F.lit(default_category)), "confidence": confidence, "account": account, "keywords": F.coalesce("keywords", F.array().cast("array<string>"))}).drop("score", "matches")


def classify_by_rules_simple(items: DataFrame, rules: DataFrame, brands: list[str], text: str = "description", supplier: str = "supplier") -> DataFrame:
    """The other weighting: 1 + len/10 a keyword, a bonus for brands, at most .95; account null without a hit."""
    rest = items.drop("category", "account", "confidence")
    entries = rules.select("cat_ord", "kw_ord", "category", "account", "keyword").limit(MAX_IN_PLAN + 1).collect()
    if 0 < len(entries) <= MAX_IN_PLAN:
        out = _in_row(rest, entries, text, supplier, bonuses=False).select(*rest.columns, "_r.*")
    else:
        best = _best(keyword_hits(items, rules, text, supplier), 1 + 0.1 * F.length("keyword"))
        out = rest.join(best, F.col(text).eqNullSafe(F.col("_text")) & F.col(supplier).eqNullSafe(F.col("_supplier")), "left").drop("_text", "_supplier")
    brand = F.when(F.lower(text).rlike("|".join(map(re.escape, brands))), 0.15).otherwise(0.0)
    full = F.least(F.lit(0.95), F.least(F.lit(0.9), 0.3 + 0.1 * F.col("score")) + F.least(F.lit(0.2), 0.05 * F.col("matches")) + brand)
    return out.withColumn("confidence", F.when(F.col("score").isNull(), 0.2).otherwise(full)).drop("score", "matches", "keywords")


def combine(rule_conf: Column, rag_conf: Column, same: Column) -> tuple[Column, Column]:
    """(method, confidence) of a rule result and a neighbour result, by thresholds .7, .4 and .2."""
    method = F.when(rag_conf < 0.2, "rule_fallback").when((rule_conf >= 0.7) & (rag_conf < 0.4), "rule_dominant").when((rag_conf >= 0.7) & (rule_conf < 0.4), "rag_dominant").when(same, "consensus").otherwise("conflict")
    mean, high = (rule_conf + rag_conf) / 2, F.greatest(rule_conf, rag_conf)
    return method, F.when(method.isin("rule_fallback", "rule_dominant"), rule_conf).when(method == "rag_dominant", rag_conf).when(method == "consensus", mean).otherwise(high * 0.9)


def supplier_boost(matched: Column, keywords: Column, boost: Column) -> Column:
    return F.coalesce(boost * F.try_divide(matched, keywords), F.lit(0.0))


def price_boost(price: Column, account: Column) -> Column:
    """First rule that fits: costly assets, cheap assets, small goods, costly goods."""
    return F.when((price >= 800) & account.startswith("04"), 0.20).when((price < 800) & account.startswith("04"), -0.10).when((price < 100) & account.startswith("3"), 0.15).when((price >= 100) & account.startswith("3"), 0.12).otherwise(0.0)


def similar_positions(items: DataFrame, threshold: float = 0.6, text: str = "description") -> DataFrame:
    """(invoice_id, position, ..., similar, consistency, boost): items of one invoice with a similar description.

    An equi-join on the invoice; invoices are bounded by their lines.
    """
    tokens = F.array_distinct(F.split(F.lower(text), " "))
    x = items.select("invoice_id", "item_id", "account", tokens.alias("t"))
    y = x.select("invoice_id", F.col("item_id").alias("other"), F.col("account").alias("other_account"), F.col("t").alias("u"))
    jaccard = F.try_divide(F.size(F.array_intersect("t", "u")), F.size(F.array_union("t", "u")))
    near = x.join(y, "invoice_id").where((F.col("item_id") != F.col("other")) & (jaccard > threshold))
    agg = near.groupBy("item_id").agg(F.count(F.lit(1)).alias("similar"), F.avg((F.col("account") == F.col("other_account")).cast("double")).alias("consistency"))
    boost = F.when(F.col("similar") < 2, 0.0).when(F.col("consistency") >= 0.8, 0.10).when(F.col("consistency") <= 0.3, -0.05).otherwise(0.0)
    return agg.withColumn("boost", boost)


def with_context(confidence: Column, boosts: dict[str, Column]) -> tuple[Column, Column]:
    """(confidence, applied): boosts added and clamped to .05 to .95, and the names of those that are not 0."""
    total = confidence
    for b in boosts.values():
        total = total + b
    return clamp(total, 0.05, 0.95), F.array_compact(F.array(*(F.when(b != 0, n) for n, b in boosts.items())))


def learn_patterns(corrections: DataFrame) -> DataFrame:
    """One pattern per (supplier, account, description): count, boost, price range of the first price, last time."""
    d = corrections.withColumn("description", F.substring("description", 1, 100))
    p = d.groupBy("supplier", "account", "description").agg(F.count(F.lit(1)).alias("n"), F.min_by("price", F.struct("ts", "feedback_id")).alias("first_price"), F.max("ts").alias("last_updated"))
    return p.withColumns({"boost": F.least(F.lit(0.3), 0.05 * F.col("n")), "price_min": 0.8 * F.col("first_price"), "price_max": 1.2 * F.col("first_price")})


def price_bucket(price: Column) -> Column:
    """Number of the price's step of half as much again, from a thousandth on; lower prices share the first."""
    return F.floor(F.ln(F.greatest(price.cast("double"), F.lit(0.001))) / math.log(1.5))


def feedback_boost(items: DataFrame, patterns: DataFrame, top: int = 3) -> DataFrame:
    """items(item_id, supplier, price, description, account, confidence) with boosted confidence.

    Equi-join on supplier and price bucket, of which a pattern's range meets two
    or three, with the range and the contained pattern as residual conditions;
    of each item's patterns the top ones by count apply. Items without a price
    meet none.
    """
    p = patterns.select(F.col("supplier").alias("_s"), F.col("account").alias("_a"), F.lower("description").alias("_d"), "n", "boost", "price_min", "price_max")
    p = p.withColumn("_bucket", F.explode(F.sequence(price_bucket(F.col("price_min")), price_bucket(F.col("price_max")))))
    near = (F.col("supplier") == F.col("_s")) & (price_bucket(F.col("price")) == F.col("_bucket"))
    met = items.join(p, near & F.col("price").between(F.col("price_min"), F.col("price_max")) & F.lower("description").contains(F.col("_d")))
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "_a", "_d"))).where(F.col("r") <= top)
    change = F.when(F.col("_a") == F.col("account"), F.col("boost") * F.col("n") / 10).otherwise(-0.1 * F.col("boost"))
    total = ranked.groupBy("item_id").agg(F.sum(change).alias("change"))
    return items.join(total, "item_id", "left").withColumn("confidence", F.when(F.col("change").isNull(), F.col("confidence")).otherwise(F.least(F.lit(1.0), F.col("confidence") + F.col("change")))).drop("change")


def vote(neighbours: DataFrame, query: str = "query_id") -> DataFrame:
    """Weighted vote of neighbours(query, account, similarity, confidence): account, confidence at most .95."""
    per = neighbours.groupBy(query, "account").agg(F.sum(F.col("similarity") * F.col("confidence")).alias("w"))
    best = per.groupBy(query).agg(F.max_by("account", F.struct("w", F.col("account"))).alias("account"), F.max("w").alias("best"), F.sum("w").alias("total"))
    return best.select(query, "account", F.least(F.lit(0.95), F.coalesce(F.try_divide("best", "total"), F.lit(0.1))).alias("confidence"))


def vote_details(queries: DataFrame, neighbours: DataFrame, query: str = "query_id", top: int = 3) -> DataFrame:
    """The weighted vote with its reasons, a row per row of queries(query).

    neighbours(query, rank, account, category, supplier, example, similarity,
    confidence) are the found bookings, best first. Each account gathers
    similarity * confidence; of equal accounts the one seen first wins, with its
    first category and its most frequent supplier (by name on ties). The
    examples are the first ones of all neighbours. Without neighbours: the
    fallback account with confidence .1.
    """
    n = neighbours.withColumn("_w", F.col("similarity") * F.col("confidence"))
    per = n.groupBy(query, "account").agg(F.sum("_w").alias("w"), F.min("rank").alias("seen"), F.min_by("category", "rank").alias("category"))
    best = per.groupBy(query).agg(F.max_by(F.struct("account", "category"), F.struct("w", -F.col("seen"))).alias("_b"), F.max("w").alias("best"), F.sum("w").alias("total"))
    suppliers = n.groupBy(query, "account", "supplier").agg(F.count(F.lit(1)).alias("n")).groupBy(query, "account").agg(F.min_by("supplier", F.struct(-F.col("n"), F.col("supplier"))).alias("supplier"))
    examples = n.where(F.col("rank") <= top).groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))), lambda x: x["example"]).alias("examples"))
    won = best.select(query, "_b.account", "_b.category", F.least(F.lit(0.95), F.try_divide("best", "total")).alias("confidence")).join(suppliers, [query, "account"], "left").join(examples, query, "left")
    out = queries.select(query).join(won, query, "left")
    return out.select(query, F.coalesce("account", F.lit(FALLBACK_ACCOUNT)).alias("account"), F.coalesce("category", F.lit("Unbekannt")).alias("category"), F.coalesce("confidence", F.lit(0.1)).alias("confidence"), "supplier", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), F.when(F.col("account").isNull(), "fallback").otherwise("rag_similarity").alias("method"))
