"""Text features, extraction of fields and tables, spans and annotations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import spread


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: what a lambda refers to is computed anew for each element, its own variables are not."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Non-empty words between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def mean_length(tokens: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(tokens, F.lit(0), lambda s, w: s + F.length(w)), F.size(tokens)), F.lit(0.0))


def basic_stats(text: Column) -> dict[str, Column]:
    w, n = words(text), F.greatest(F.length(text), F.lit(1))
    return {
        "n_chars": F.length(text),
        "n_words": F.size(w),
        "mean_word": mean_length(w),
        "n_sentences": F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != "")),
        "digit_ratio": F.regexp_count(text, F.lit("[0-9]")) / n,
        "upper_ratio": F.regexp_count(text, F.lit("[A-Z]")) / n,
        "punctuation_ratio": F.regexp_count(text, F.lit("[.,;:!?]")) / n,
    }


def keyword_counts(text: Column, catalogue: dict[str, list[str]]) -> dict[str, Column]:
    """Of each category the keywords that occur in the lower-cased text."""
    low = F.lower(text)
    return {c: F.size(F.filter(F.array(*map(F.lit, k)), lambda w: F.contains(low, w))) for c, k in catalogue.items()}


def most_frequent(items: Column, k: int) -> Column:
    """array<struct<neg, first, item>>: the k most frequent items of an array with their negative counts, ties by first place.

    Equal items lie side by side after sorting, so the counts are the distances
    between the places where the item changes.
    """
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("first"))))

    def counted(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (x["item"] != F.get(s, j - 1)["item"]), j)), lambda j: j.isNotNull())
        return bind(heads, lambda h: F.transform(h, lambda j, r: F.struct((j - F.coalesce(F.get(h, r + 1), F.size(s))).alias("neg"), F.get(s, j)["first"].alias("first"), j.alias("at"))))

    def best(c: Column) -> Column:
        # With k items that come twice, no other is among the best; most are then not sorted.
        return bind(F.filter(c, lambda x: x["neg"] < -1), lambda m: F.slice(F.array_sort(F.when(F.size(m) >= k, m).otherwise(c)), 1, k))

    return bind(placed, lambda s: F.transform(bind(counted(s), best), lambda x: F.struct(x["neg"], x["first"], F.get(s, x["at"])["item"].alias("item"))))


def top_ngrams(docs: DataFrame, n: int, k: int, stopwords: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, gram, count, rank): the k most frequent n-grams of each document without stopwords, ties by first place."""
    kept = F.filter(F.split(F.lower(text), r"[^a-zäöüßéèêàçñóíúáâîôû]+"), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))
    gram = lambda w: F.transform(F.slice(w, 1, F.size(w) - (n - 1)), lambda x, i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(n))))
    best = bind(kept, lambda w: F.when(F.size(w) >= n, most_frequent(w if n == 1 else gram(w), k)))
    d = spread(docs.select(key, text)).select(key, F.posexplode(best).alias("_rank", "_g"))
    return d.select(key, F.col("_g.item").alias("gram"), (-F.col("_g.neg")).cast("long").alias("count"), (F.col("_rank") + 1).alias("rank"))


def block_stats(text: Column) -> dict[str, Column]:
    """Lines as blocks: number, mean, least and greatest length, population variance, share of short ones."""
    lengths = F.transform(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), lambda s: F.length(s).cast("double"))
    n = F.size(lengths)
    mean = F.try_divide(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x), n)
    square = F.try_divide(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x), n)
    return {"n_blocks": n, "mean_block": F.coalesce(mean, F.lit(0.0)), "least_block": F.coalesce(F.array_min(lengths), F.lit(0.0)), "greatest_block": F.coalesce(F.array_max(lengths), F.lit(0.0)), "block_variance": F.coalesce(square - mean * mean, F.lit(0.0)), "short_blocks": F.coalesce(F.try_divide(F.size(F.filter(lengths, lambda x: x < 50)), n), F.lit(0.0))}


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null where there is none."""
    return F.nullif(F.regexp_extract(text, "(?im)" + pattern, group), F.lit(""))


def field_map(text: Column, patterns: dict[str, str]) -> Column:
    """A map of the fields that are found."""
    entries = F.array_compact(F.array(*(F.when(first_group(text, p).isNotNull(), F.struct(F.lit(k).alias("key"), first_group(text, p).alias("value"))) for k, p in patterns.items())))
    return F.map_from_entries(entries)


def last_matching_line(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value): the first group on the last line that matches."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("value", F.regexp_extract("line", pattern, 1)).where("value <> ''")
    return lines.groupBy(key).agg(F.max_by("value", "pos").alias("value"))


def parse_table(text: Column) -> Column:
    """Rows of cells of a text: cells are split at bars or at two blanks, blank rows go."""
    rows = F.transform(F.split(text, "\n"), lambda line: F.transform(F.split(F.trim(line), r"\s*\|\s*|\s{2,}"), lambda c: F.trim(c)))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def cell_grid(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, row, cells): cells(key, row, col, value) as full rows, blanks where a cell is missing."""
    dims = cells.groupBy(key).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    grid = dims.select(key, F.explode(F.sequence(F.lit(0), F.col("rows"))).alias("row"), "cols").select(key, "row", F.explode(F.sequence(F.lit(0), F.col("cols"))).alias("col"))
    full = grid.join(cells, [key, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit("")))
    return full.groupBy(key, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("cells"))


def normalize_headers(headers: Column, variants: list[tuple[str, list[str]]]) -> Column:
    """Canonical names in order; a header without a known variant becomes column_i."""
    def name(h: Column, i: Column) -> Column:
        out = None
        for canonical, forms in variants:
            test = F.lower(h).rlike("|".join(forms))
            out = F.when(test, canonical) if out is None else out.when(test, canonical)
        return out.otherwise(F.concat(F.lit("column_"), i.cast("string")))

    return F.transform(headers, name)


def chunks(text: Column, size: int = 5000) -> Column:
    n = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def fenced_json(text: Column) -> Column:
    """JSON inside a fence, else from the first to the last brace."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def pattern_spans(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, offsets in code points, without a UDF: gaps and matches alternate.

    A start is the sum of all gaps and matches before it, taken from sums of
    blocks of about the square root of their number.
    """
    found = F.regexp_extract_all(text, F.lit("(" + pattern + ")"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def stepped(s: Column) -> Column:
        steps = F.transform(s["found"], lambda m, i: F.get(s["gaps"], i) + F.length(m))
        return bind(F.struct(s["found"].alias("found"), s["gaps"].alias("gaps"), steps.alias("steps"), F.ceil(F.sqrt(F.size(s["found"]))).cast("int").alias("b")), blocked)

    def blocked(s: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), s["b"]), lambda k: total(F.slice(s["steps"], k * s["b"] + 1, s["b"])))
        return bind(sums, lambda t: bind(F.transform(t, lambda _, k: total(F.slice(t, 1, k))), lambda before: F.transform(s["found"], lambda m, i: placed(s, before, m, i))))

    def placed(s: Column, before: Column, m: Column, i: Column) -> Column:
        k = F.floor(i / s["b"]).cast("int")
        start = F.get(before, k) + total(F.slice(s["steps"], k * s["b"] + 1, i - k * s["b"])) + F.get(s["gaps"], i)
        return bind(start, lambda a: F.struct(a.cast("int").alias("start"), (a + F.length(m)).cast("int").alias("end"), m.alias("value")))

    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    return bind(F.struct(found.alias("found"), gaps.alias("gaps")), lambda s: F.when(F.size(s["found"]) > 0, stepped(s)).otherwise(none))


def without_overlaps(spans: Column) -> Column:
    """Spans by start, overlapping ones reduced to the longer (the earlier on ties)."""
    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart, longer = s["start"] >= last["end"], (s["end"] - s["start"]) > (last["end"] - last["start"])
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))
        return F.when((F.size(kept) == 0) | apart, F.concat(kept, F.array(s))).when(longer, swapped).otherwise(kept)

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), step)


def corrected_span(text: Column, entity: Column, start: Column, end: Column) -> Column:
    """(start, end, confidence): the exact slice 1.0, else found .95 (in any case), else kept .5 in bounds and .3 out of them."""
    slice_ = F.substring(text, start + 1, end - start)
    exact, any_case = F.instr(text, entity) - 1, F.instr(F.lower(text), F.lower(entity)) - 1
    n = F.length(entity)

    def out(a: Column, z: Column, c: float) -> Column:
        return F.struct(a.cast("int").alias("start"), z.cast("int").alias("end"), F.lit(c).alias("confidence"))

    return F.when(slice_ == entity, out(start, end, 1.0)).when(exact >= 0, out(exact, exact + n, 0.95)).when(any_case >= 0, out(any_case, any_case + n, 0.95)).when((start >= 0) & (end <= F.length(text)) & (start < end), out(start, end, 0.5)).otherwise(out(start, end, 0.3))


def corrected_annotation(text: Column, entity: Column, start: Column, end: Column, label: Column, brands: list[str], brand_label: str = "MARKE") -> Column:
    """(text, label, start, end, confidence, corrected, fuzzy, fallback) of one annotation.

    Positions out of the text fall back to the entity's length at 0 with .3. The
    right slice (blanks at its ends aside) has 1.0; an entity found elsewhere, in
    any case, .95; a known brand under the brand label takes the first brand of
    the list that the text has, .8; all others keep their place with .5.
    """
    exact, any_case = F.instr(text, entity) - 1, F.instr(F.lower(text), F.lower(entity)) - 1
    found = F.when(exact >= 0, exact).otherwise(any_case)
    held = F.array_max(F.array(F.struct(F.lit(-len(brands)).alias("order"), F.lit(None).cast("string").alias("brand")), *(F.when(F.contains(F.lower(text), F.lit(b.lower())), F.struct(F.lit(-k).alias("order"), F.lit(b).alias("brand"))) for k, b in enumerate(brands))))["brand"]
    brand = F.when((label == brand_label) & F.upper(entity).isin(brands), held)

    def out(value: Column, a: Column, z: Column, confidence: float, corrected: bool = False, fuzzy: bool = False, fallback: bool = False) -> Column:
        return F.struct(value.alias("text"), label.alias("label"), a.cast("int").alias("start"), z.cast("int").alias("end"), F.lit(confidence).alias("confidence"), F.lit(corrected).alias("corrected"), F.lit(fuzzy).alias("fuzzy"), F.lit(fallback).alias("fallback"))

    bad = (start < 0) | (end > F.length(text)) | (start >= end)
    at = F.instr(F.lower(text), F.lower(brand)) - 1  # upper case would make two letters of ß
    return (
        F.when(bad, out(entity, F.lit(0), F.length(entity), 0.3, fallback=True))
        .when(F.trim(F.substring(text, start + 1, end - start)) == F.trim(entity), out(entity, start, end, 1.0))
        .when(found >= 0, out(entity, found, found + F.length(entity), 0.95, corrected=True))
        .when(brand.isNotNull(), out(brand, at, at + F.length(brand), 0.8, corrected=True, fuzzy=True))
        .otherwise(out(entity, start, end, 0.5))
    )


def correction_counts(corrected: Column) -> list[Column]:
    """Sums over corrected annotations: total, corrected, exact, fuzzy and fallback."""
    return [F.count(F.lit(1)).alias("total"), F.count_if(corrected["corrected"]).alias("corrected"), F.count_if(corrected["confidence"] == 1.0).alias("exact"), F.count_if(corrected["fuzzy"]).alias("fuzzy"), F.count_if(corrected["fallback"]).alias("fallback")]


def annotation_fault(text: Column, annotation: Column) -> Column:
    """Why an annotation does not fit its text: position, mismatch or confidence; null if it fits."""
    a, z = annotation["start"], annotation["end"]
    return F.when((a < 0) | (z > F.length(text)) | (a >= z), "position").when(F.trim(F.substring(text, a + 1, z - a)) != F.trim(annotation["text"]), "mismatch").when(annotation["confidence"] < 0.3, "confidence")


def annotation_report(fault: Column, confidence: Column) -> list[Column]:
    """Sums over annotations: valid, invalid, mean confidence of the valid ones, share of valid ones."""
    valid = F.count_if(fault.isNull())
    return [valid.alias("valid"), (F.count(F.lit(1)) - valid).alias("invalid"), F.coalesce(F.avg(F.when(fault.isNull(), confidence)), F.lit(0.0)).alias("mean_confidence"), (valid / F.count(F.lit(1))).alias("quality")]


def span_scores(gold: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("doc_id", "start", "end", "label")) -> DataFrame:
    """(gold, predicted, hits, precision, recall, f1), one row, by exact match of distinct spans on keys."""
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).unionByName(predicted.select(*keys).distinct().withColumn("p", F.lit(1)), allowMissingColumns=True)
    met = both.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    t = met.agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count(F.col("g") + F.col("p")).alias("hits"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    t = t.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("gold"))})
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def variance_of(long: DataFrame) -> DataFrame:
    """(feature, n, variance) of long(feature, value)."""
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.var_pop("value").alias("variance"))


def correlation_with(long: DataFrame) -> DataFrame:
    """(feature, r) of long(feature, value, target); features without variance are left out."""
    r = long.groupBy("feature").agg(F.corr("value", "target").alias("r"))
    return r.where(F.col("r").isNotNull() & ~F.isnan("r"))
