"""Queries of extraction, entities, annotations, text features, vectors and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import neighbours as N
from ..operators import rules as R
from ..operators import scan as SC
from ..operators import tables as TB
from ..operators import texts as X
from ..operators import training as T
from ..operators import vectors as V
from ..sources.scratch import stored
from .registry import query

FIELDS = {"email": r"([a-z0-9._-]+@[a-z0-9.-]+[a-z])", "ip": r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b", "token": r'token = "([0-9a-f]+)"'}

LONG_NUMBER = r"\b([0-9]{13,16})\b"


def _first(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '(?im){pattern}', 1), '')"


@query(f"SELECT doc_id, {_first(FIELDS['email'])} AS email, {_first(FIELDS['ip'])} AS ip, {_first(FIELDS['token'])} AS token FROM documents")
def extracted_fields(t):
    m = X.field_map(F.col("text"), FIELDS)
    return t.documents.select("doc_id", *(F.try_element_at(m, F.lit(k)).alias(k) for k in FIELDS))


@query(r"SELECT doc_id, arg_max(v, pos) AS value FROM (SELECT doc_id, pos, regexp_extract(line, '^([A-Z][a-z]+) ', 1) AS v FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE v <> '' GROUP BY 1")
def last_line_field(t):
    return X.last_matching_line(t.documents, r"^([A-Z][a-z]+) ")


@query("SELECT l_orderkey AS table_id, CAST(r AS INT) AS row, array_to_string(list(v ORDER BY c), '|') AS cells FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r, CAST(l_partkey AS VARCHAR) AS a, CAST(l_linenumber AS VARCHAR) AS b FROM lineitem) CROSS JOIN LATERAL (VALUES (0, a), (1, b)) AS x(c, v) GROUP BY 1, 2")
def table_rows(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    d = t.lineitem.withColumn("row", F.row_number().over(w) - 1).select(F.col("l_orderkey").alias("table_id"), "row", F.posexplode(F.array(F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("col", "value"))
    return X.cell_grid(d).select("table_id", "row", F.array_join("cells", "|").alias("cells"))


@query(r"SELECT doc_id, len(r) AS n_rows, coalesce(list_max(list_transform(r, lambda x: len(x))), 0) AS width FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: list_transform(regexp_split_to_array(trim(l), '\s*\|\s*|\s{2,}'), lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS r FROM documents)")
def text_tables(t):
    r = X.parse_table(F.col("text"))
    return t.documents.select("doc_id", F.size(r).alias("n_rows"), F.coalesce(F.array_max(F.transform(r, lambda x: F.size(x))), F.lit(0)).alias("width"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'bolt|ring|promo') THEN 'fastener' WHEN regexp_matches(lower(p_name), 'gear|small') THEN 'machine' ELSE 'column_0' END || ',' || CASE WHEN regexp_matches(lower(p_type), 'bolt|ring|promo') THEN 'fastener' WHEN regexp_matches(lower(p_type), 'gear|small') THEN 'machine' ELSE 'column_1' END AS headers FROM part")
def normalized_headers(t):
    h = X.normalize_headers(F.array("p_name", "p_type"), [("fastener", ["bolt", "ring", "promo"]), ("machine", ["gear", "small"])])
    return t.part.select("p_partkey", F.array_join(h, ",").alias("headers"))


@query(r"SELECT conv_id, turn, CASE WHEN len(a) >= 2 THEN 'numbers' WHEN len(b) >= 2 THEN 'capitals' ELSE 'none' END AS pattern, CASE WHEN len(a) >= 2 THEN len(a) WHEN len(b) >= 2 THEN len(b) ELSE 0 END AS n FROM (SELECT conv_id, turn, regexp_extract_all(text, '[0-9]+') AS a, regexp_extract_all(text, '[A-Z][a-z]+') AS b FROM conversations)")
def pattern_tables(t):
    a, b = (F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in ("[0-9]+", "[A-Z][a-z]+"))
    return t.conversations.select("conv_id", "turn", F.when(F.size(a) >= 2, "numbers").when(F.size(b) >= 2, "capitals").otherwise("none").alias("pattern"), F.when(F.size(a) >= 2, F.size(a)).when(F.size(b) >= 2, F.size(b)).otherwise(0).alias("n"))


@query("SELECT doc_id, round(0.4 * least(length(text) / 5000, 1) + 0.2 * least((length(text) - length(replace(text, '|', ''))) / 3, 1) + 0.3 * (CASE WHEN contains(text, '@') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'token') THEN 1 ELSE 0 END) / 4 + 0.1, 9) AS score FROM documents")
def extraction_quality(t):
    bars = F.regexp_count("text", F.lit(r"\|"))
    fields = F.col("text").contains("@").cast("int") + F.col("text").contains("token").cast("int")
    return t.documents.select("doc_id", F.round(0.4 * F.least(F.length("text") / 5000, F.lit(1.0)) + 0.2 * F.least(bars / 3, F.lit(1.0)) + 0.3 * fields / 4 + 0.1, 9).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE nullif(props, '') END AS json, json_extract_string(props, '$.k') AS k FROM events")
def fenced_responses(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("text\n```json\n"), "props", F.lit("```"))).otherwise(F.concat(F.lit("answer: "), "props", F.lit(" end")))
    j = X.fenced_json(raw)
    return t.events.select("event_id", j.alias("json"), F.from_json(j, "k string").getField("k").alias("k"))


@query("SELECT doc_id, len(c) AS n, md5(array_to_string(c, '')) = md5(text) AS whole FROM (SELECT doc_id, text, list_transform(range(greatest(CAST(ceil(length(text) / 5000) AS BIGINT), 1)), lambda i: substr(text, i * 5000 + 1, 5000)) AS c FROM documents)")
def text_chunks(t):
    c = X.chunks(F.col("text"))
    return t.documents.select("doc_id", F.size(c).alias("n"), (F.md5(F.array_join(c, "")) == F.md5("text")).alias("whole"))


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, 'high' AS severity FROM lines WHERE regexp_matches(line, 'token = "[0-9a-f]+"') UNION ALL SELECT doc_id, 'medium' FROM lines WHERE regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+') UNION ALL SELECT doc_id, 'low' FROM lines WHERE regexp_matches(line, '[0-9]{13,16}')) GROUP BY 1""")
def risk_scan(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rules = [("high", r'token = "[0-9a-f]+"'), ("medium", r"[a-z0-9.]+@[a-z0-9.]+"), ("low", r"[0-9]{13,16}")]
    found = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), s) for s, p in rules)))
    return lines.select("doc_id", F.explode(found).alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


ENTITY = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[a-z0-9.]+@[a-z0-9.]+[a-z]"


@query(f"SELECT doc_id, len(m) AS n, len(list_distinct(m)) AS n_distinct, array_to_string(m, ',') AS found FROM (SELECT doc_id, regexp_extract_all(text, '{ENTITY}') AS m FROM documents)")
def entity_counts(t):
    m = F.regexp_extract_all("text", F.lit(f"({ENTITY})"), F.lit(1))
    return t.documents.select("doc_id", F.size(m).alias("n"), F.size(F.array_distinct(m)).alias("n_distinct"), F.array_join(m, ",").alias("found"))


def _spans_sql(pattern: str) -> str:
    return f"""(SELECT doc_id, text, found[i] AS value, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS INT) AS start
 FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS gaps FROM documents)))"""


SPANS_SQL = f"spans AS (SELECT doc_id, text, value, start, CAST(start + length(value) AS INT) AS end_, CASE WHEN contains(value, '@') THEN 'email' ELSE 'ip' END AS label FROM {_spans_sql(ENTITY)})"


RISKS = [
    SC.Pattern("credentials", "high", r"(?i)(?:password|secret|key|token)\s*=\s*[\"\x27][^\"\x27]+[\"\x27]", ("password", "secret", "key", "token")),
    SC.Pattern("address", "medium", r"[a-z0-9.]+@[a-z0-9.]+", ("@",)),
    SC.Pattern("long number", "low", r"[0-9]{13,16}"),
]
RISKS_SQL = "found AS (" + " UNION ALL ".join(f"SELECT doc_id, '{p.name}' AS pattern, '{p.severity}' AS severity, text, value, start FROM {_spans_sql(p.regex)}" for p in RISKS) + ")"


@query(f"WITH {RISKS_SQL} SELECT doc_id, pattern, severity, 1 + length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) AS line, start, value AS match FROM found")
def risk_findings(t):
    """Every match of every risk pattern in whole texts, with its line."""
    return SC.pattern_findings(t.documents, "doc_id", "text", RISKS).drop("number")


@query(f"WITH {RISKS_SQL} SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM found")
def risk_totals(t):
    return SC.severity_counts(SC.pattern_findings(t.documents, "doc_id", "text", RISKS))


TABLE_PATTERNS = [TB.TablePattern(r'([a-z]+) = "([0-9a-f]+)"', 2, ("name", "value")), TB.TablePattern(r"([A-Z][a-z]+) ([a-z]+), ([a-z]+)", 3, ("first", "second", "third")), TB.TablePattern(r"([0-9]{3,})\D+([0-9]{3,})", 2)]
VARIANTS = [("value", ["^value", "^v"]), ("name", ["^name", "^first", "^th"])]
BARS_SQL = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 barred AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM lines WHERE contains(line, '|')),
 celled AS (SELECT doc_id, run, i, list_transform(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM barred),
 kept AS (SELECT * FROM celled WHERE len(list_filter(cells, lambda c: c <> '' AND NOT regexp_full_match(c, ':?-+:?'))) > 0),
 runs AS (SELECT doc_id, run, list(cells ORDER BY i) AS r FROM kept GROUP BY 1, 2 HAVING count(*) > 1),
 bars AS (SELECT doc_id, 'bars' AS method, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INT) AS table_index, r[1] AS headers, r[2:] AS body, 0.9 AS confidence FROM runs)"""


def _pattern_sql(patterns: list, source: str, keys: str, least: int, chars: int, confidence: float) -> str:
    """The first pattern with enough matches, as SQL: a table (keys, method, table_index, headers, body, confidence)."""
    parts = []
    for k, p in enumerate(patterns):
        groups = ", ".join(f"regexp_extract_all(text, '{p.regex}', {g})[j]" for g in range(1, p.groups + 1))
        names = list(p.headers or [f"column_{g}" for g in range(1, p.groups + 1)])
        parts.append(f"SELECT {keys}, {k} AS table_index, {names} AS headers, list_transform(range(1, len(regexp_extract_all(text, '{p.regex}')) + 1), lambda j: [{groups}]) AS body FROM {source} WHERE length(trim(text)) >= {chars} AND len(regexp_extract_all(text, '{p.regex}')) >= {least}")
    return f"(SELECT {keys}, 'pattern' AS method, table_index, headers, body, {confidence} AS confidence FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY table_index) = 1)"


TABLES_SQL = f"{BARS_SQL}, pattern AS {_pattern_sql(TABLE_PATTERNS, '(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bars))', 'doc_id', 2, 100, 0.6)}, tables AS (SELECT * FROM bars UNION ALL SELECT * FROM pattern)"
NORMAL_SQL = "array_to_string(list_transform(headers, lambda h, i: CASE WHEN regexp_matches(lower(h), '^value|^v') THEN 'value' WHEN regexp_matches(lower(h), '^name|^first|^th') THEN 'name' ELSE 'column_' || CAST(i - 1 AS VARCHAR) END), ',')"
TABLE_COLUMNS_SQL = f"method, table_index, array_to_string(headers, ',') AS headers, {NORMAL_SQL} AS normalized_headers, sha256(array_to_string(list_transform(body, lambda r: array_to_string(r, '|')), chr(10))) AS rows_sha256, len(body) AS row_count, len(headers) AS column_count, confidence"


def table_columns(d, *keys: str):
    parts = TB.described(F.col("table"), VARIANTS)
    text = F.array_join(F.transform(parts["rows"], lambda r: F.array_join(r, "|")), "\n")
    return d.select(*keys, F.explode("tables").alias("table")).select(*keys, "table.method", "table.table_index", F.array_join(parts["headers"], ",").alias("headers"), F.array_join(parts["normalized_headers"], ",").alias("normalized_headers"), F.sha2(text, 256).alias("rows_sha256"), parts["row_count"].alias("row_count"), parts["column_count"].alias("column_count"), "table.confidence")


def tiered_tables():
    return TB.first_tier([TB.bar_tables(F.col("text")), TB.pattern_tables(F.col("text"), TABLE_PATTERNS)])


@query(f"WITH {TABLES_SQL} SELECT doc_id, {TABLE_COLUMNS_SQL} FROM tables")
def extracted_tables(t):
    """Tables of whole texts by tiers: lines with bars, else the first pattern with two matches."""
    return table_columns(t.documents.select("doc_id", tiered_tables().alias("tables")), "doc_id")


@query(f"WITH pages AS (SELECT * FROM conversations), tables AS {_pattern_sql(TABLE_PATTERNS[1:], 'pages', 'conv_id, turn', 1, 0, 0.7)} SELECT conv_id, turn, {TABLE_COLUMNS_SQL} FROM tables")
def page_tables(t):
    """Tables of single pages (turns), by the first pattern that matches at all."""
    tables = TB.pattern_tables(F.col("text"), TABLE_PATTERNS[1:], least_rows=1, least_chars=0, confidence=0.7)
    return table_columns(t.conversations.select("conv_id", "turn", tables.alias("tables")), "conv_id", "turn")


@query("WITH " + TABLES_SQL + f""", f AS (SELECT doc_id, text, CAST({_first(FIELDS['token'])} IS NOT NULL AS INT) + CAST({_first(FIELDS['ip'])} IS NOT NULL AS INT) + CAST({_first(LONG_NUMBER)} IS NOT NULL AS INT) + CAST({_first(FIELDS['email'])} IS NOT NULL AS INT) AS fields FROM documents),
 n AS (SELECT doc_id, count(*) AS tables FROM tables GROUP BY 1) SELECT f.doc_id, fields, coalesce(tables, 0) AS tables, round((0.4 * least(length(text) / 5000, 1) + 0.2 * least(coalesce(tables, 0) / 3, 1) + 0.3 * fields / 4 + CASE WHEN length(text) > 0 THEN 0.1 ELSE 0 END) / 1.0, 9) AS score FROM f LEFT JOIN n ON n.doc_id = f.doc_id""")
def extraction_scores(t):
    """Quality of extraction with the tables and the four named fields that each text has."""
    named = dict(zip(TB.FIELDS, (FIELDS["token"], FIELDS["ip"], LONG_NUMBER, FIELDS["email"]), strict=True))
    d = t.documents.select("doc_id", "text", tiered_tables().alias("tables"), X.field_map(F.col("text"), named).alias("fields"))
    return d.select("doc_id", F.size("fields").alias("fields"), F.size("tables").alias("tables"), F.round(TB.extraction_score(F.col("text"), F.col("tables"), F.col("fields"), F.length("text")), 9).alias("score"))


@query(f"WITH {SPANS_SQL} SELECT doc_id, start, end_ AS \"end\", value FROM spans")
def entity_spans(t):
    s = X.without_overlaps(X.pattern_spans(F.col("text"), ENTITY))
    return t.documents.select("doc_id", F.explode(s).alias("s")).select("doc_id", "s.start", "s.end", "s.value")


@query(f"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{ENTITY}')) AS v FROM documents) SELECT CASE WHEN contains(v, '@') THEN 'email' ELSE 'ip' END AS label, count(*) AS n, count(DISTINCT doc_id) AS documents FROM e GROUP BY 1")
def entity_statistics(t):
    e = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({ENTITY})"), F.lit(1))).alias("s"))
    return e.groupBy(F.when(F.contains("s", F.lit("@")), "email").otherwise("ip").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(r"SELECT doc_id, count(*) FILTER (regexp_full_match(w, '[0-9]+')) AS numbers, count(*) FILTER (regexp_full_match(w, '[A-Z][a-z]+')) AS names FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) GROUP BY 1")
def token_rules(t):
    w = F.split("text", r"\s+")
    of = lambda p: F.size(F.filter(w, lambda x: F.regexp_like(x, F.lit(p)))).cast("long")
    return t.documents.where("text IS NOT NULL").select("doc_id", of("^[0-9]+$").alias("numbers"), of("^[A-Z][a-z]+$").alias("names"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN instr(text, w) > 0 THEN CASE WHEN substr(text, 6, length(w)) = w THEN 1.0 ELSE 0.95 END ELSE 0.5 END AS confidence FROM (SELECT doc_id, text, substr(text, 1, 5) AS w FROM documents WHERE length(text) > 20)""")
def corrected_annotations(t):
    d = t.documents.where("length(text) > 20").withColumn("w", F.substring("text", 1, 5)).withColumn("start", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(5))
    return d.select("doc_id", X.corrected_span(F.col("text"), F.col("w"), F.col("start"), F.col("start") + 5)["confidence"].alias("confidence"))


@query("SELECT source, count(*) AS total, count(*) FILTER (n_chars > 100) AS valid, round(count(*) FILTER (n_chars > 100) / count(*), 9) AS quality FROM documents GROUP BY 1")
def annotation_validation(t):
    g = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") > 100).alias("valid"))
    return g.withColumn("quality", F.round(F.col("valid") / F.col("total"), 9))


# Annotations whose places are off by 0 to 3 characters, every fifth in capitals, under a brand's label where they are addresses.
SHIFTED_SQL = f"""{SPANS_SQL}, shifted AS (SELECT doc_id, text, CASE WHEN (doc_id + start) % 5 = 0 THEN upper(value) ELSE value END AS entity, start + start % 4 AS s, end_ + start % 4 AS e, label FROM spans),
 facts AS (SELECT *, s < 0 OR e > length(text) OR s >= e AS bad, trim(substr(text, s + 1, e - s)) = trim(entity) AS same, CASE WHEN instr(text, entity) > 0 THEN instr(text, entity) ELSE instr(lower(text), lower(entity)) END - 1 AS place FROM shifted),
 corrected AS (SELECT *, CASE WHEN bad THEN 0 WHEN same THEN s WHEN place >= 0 THEN place ELSE s END AS cs, CASE WHEN bad THEN length(entity) WHEN same THEN e WHEN place >= 0 THEN place + length(entity) ELSE e END AS ce, CASE WHEN bad THEN 0.3 WHEN same THEN 1.0 WHEN place >= 0 THEN 0.95 ELSE 0.5 END AS conf FROM facts)"""


def shifted_annotations(t):
    off = F.col("s.start") % 4
    d = t.documents.select("doc_id", "text", F.explode(X.pattern_spans(F.col("text"), ENTITY)).alias("s"))
    entity = F.when((F.col("doc_id") + F.col("s.start")) % 5 == 0, F.upper("s.value")).otherwise(F.col("s.value"))
    label = F.when(F.contains("s.value", F.lit("@")), "email").otherwise("ip")
    return d.withColumn("c", X.corrected_annotation(F.col("text"), entity, F.col("s.start") + off, F.col("s.end") + off, label, ["GIRA", "HAGER"]))


@query(f"WITH {SHIFTED_SQL} SELECT doc_id, entity, label, CAST(cs AS INT) AS start, CAST(ce AS INT) AS \"end\", conf AS confidence, count(*) AS n FROM corrected GROUP BY ALL")
def annotation_corrections(t):
    return shifted_annotations(t).groupBy("doc_id", F.col("c.text").alias("entity"), "c.label", "c.start", "c.end", "c.confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SHIFTED_SQL} SELECT doc_id, count(*) AS total, count(*) FILTER (conf = 0.95) AS corrected, count(*) FILTER (conf = 1.0) AS exact, 0 AS fuzzy, count(*) FILTER (conf = 0.3) AS fallback FROM corrected GROUP BY 1")
def annotation_batch_counts(t):
    return shifted_annotations(t).groupBy("doc_id").agg(*X.correction_counts(F.col("c")))


@query(f"""WITH {SHIFTED_SQL}, checked AS (SELECT *, NOT (cs < 0 OR ce > length(text) OR cs >= ce) AND trim(substr(text, cs + 1, ce - cs)) = trim(entity) AND conf >= 0.3 AS ok FROM corrected)
 SELECT doc_id, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, round(coalesce(avg(conf) FILTER (ok), 0), 9) AS mean_confidence, round(count(*) FILTER (ok) / count(*), 9) AS quality FROM checked GROUP BY 1""")
def annotation_quality(t):
    d = shifted_annotations(t).withColumn("fault", X.annotation_fault(F.col("text"), F.col("c")))
    r = d.groupBy("doc_id").agg(*X.annotation_report(F.col("fault"), F.col("c.confidence")))
    return r.withColumns({c: F.round(c, 9) for c in ("mean_confidence", "quality")})


TEXT_BRANDS = ["THE", "UND", "LES", "QUE"]


@query(f"""WITH d AS (SELECT doc_id, text, CASE WHEN instr(text, 'THE') > 0 THEN instr(text, 'THE') ELSE instr(lower(text), 'the') END - 1 AS place, list_filter({TEXT_BRANDS}, lambda b: contains(lower(text), lower(b)))[1] AS held FROM documents WHERE text IS NOT NULL),
 c AS (SELECT *, CASE WHEN length(text) < 3 THEN 'fallback' WHEN substr(text, 1, 3) = 'THE' THEN 'exact' WHEN place >= 0 THEN 'found' WHEN held IS NOT NULL THEN 'fuzzy' ELSE 'kept' END AS kind FROM d)
 SELECT doc_id, CASE kind WHEN 'fuzzy' THEN held ELSE 'THE' END AS entity, CAST(CASE kind WHEN 'found' THEN place WHEN 'fuzzy' THEN instr(lower(text), lower(held)) - 1 ELSE 0 END AS INT) AS start, CASE kind WHEN 'fallback' THEN 0.3 WHEN 'exact' THEN 1.0 WHEN 'found' THEN 0.95 WHEN 'fuzzy' THEN 0.8 ELSE 0.5 END AS confidence, kind = 'fuzzy' AS fuzzy FROM c""")
def brand_corrections(t):
    """An annotation of one brand in every document, corrected to the first brand of the list that the text has."""
    d = t.documents.where("text IS NOT NULL")
    c = X.corrected_annotation(F.col("text"), F.lit("THE"), F.lit(0), F.lit(3), F.lit("MARKE"), TEXT_BRANDS)
    return d.select("doc_id", c.alias("c")).select("doc_id", F.col("c.text").alias("entity"), "c.start", "c.confidence", "c.fuzzy")


OTHER_ENTITY = r"[a-z0-9.]+@[a-z0-9.]+[a-z]|[0-9]+\.[0-9]+"


@query(f"""WITH {SPANS_SQL}, other AS (SELECT doc_id, start, CAST(start + length(value) AS INT) AS end_, CASE WHEN contains(value, '@') THEN 'email' ELSE 'ip' END AS label FROM {_spans_sql(OTHER_ENTITY)}),
 t AS (SELECT (SELECT count(*) FROM spans) AS gold, (SELECT count(*) FROM other) AS predicted, (SELECT count(*) FROM spans JOIN other USING (doc_id, start, end_, label)) AS hits)
 SELECT gold, predicted, hits, round(hits / predicted, 9) AS precision, round(hits / gold, 9) AS recall, round(2 * (hits / predicted) * (hits / gold) / (hits / predicted + hits / gold), 9) AS f1 FROM t""")
def span_scores(t):
    """Spans of one pattern judged by those of another, over whole texts."""
    gold, predicted = (t.documents.select("doc_id", F.explode(X.pattern_spans(F.col("text"), p)).alias("s")).select("doc_id", "s.start", "s.end", F.when(F.contains("s.value", F.lit("@")), "email").otherwise("ip").alias("label")) for p in (ENTITY, OTHER_ENTITY))
    return X.span_scores(gold, predicted).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("SELECT l_orderkey, pos, s, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, p_name AS s FROM lineitem JOIN part ON p_partkey = l_partkey)")
def annotated_text_offsets(t):
    w = Window.partitionBy("l_orderkey")
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("pos", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    start = F.coalesce(F.sum(F.length("p_name") + 1).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.select("l_orderkey", "pos", F.col("p_name").alias("s"), start.alias("start"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 100 THEN 'klein' WHEN o_totalprice < 1000 THEN 'mittel' ELSE 'gross' END, CASE WHEN o_orderstatus = 'F' THEN 'final' END) AS categories FROM orders")
def training_categories(t):
    return t.orders.select("o_orderkey", F.concat_ws(",", S.total_band(F.col("o_totalprice")), F.when(F.col("o_orderstatus") == "F", "final")).alias("categories"))


@query("SELECT doc_id, coalesce(nullif(text, ''), source) AS text, CASE WHEN quality IS NULL THEN '' ELSE 'Q_' || CAST(quality AS VARCHAR) END AS cat FROM documents LEFT JOIN labels USING (doc_id)")
def training_examples(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.nullif("text", F.lit("")), "source").alias("text"), F.when(F.col("quality").isNull(), "").otherwise(F.concat(F.lit("Q_"), F.col("quality").cast("string"))).alias("cat"))


@query(r"""SELECT doc_id, length(text) AS n_chars, len(w) AS n_words, round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0), 9) AS mean_word, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '')) AS n_sentences,
 round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 9) AS digit_ratio, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1), 9) AS upper_ratio, round(length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / greatest(length(text), 1), 9) AS punctuation_ratio
 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents)""")
def text_statistics(t):
    s = X.basic_stats(F.col("text"))
    return t.documents.select("doc_id", *(F.round(c, 9).alias(k) if "ratio" in k or k == "mean_word" else c.alias(k) for k, c in s.items()))


CATALOGUE = {"english": ["the", "and", "with"], "german": ["der", "und", "nicht"], "spanish": ["que", "los"]}


@query("SELECT doc_id, " + ", ".join(f"len(list_filter({v!r}, lambda k: contains(lower(text), k))) AS {c}" for c, v in CATALOGUE.items()) + " FROM documents")
def keyword_features(t):
    return t.documents.select("doc_id", *(c.alias(k) for k, c in X.keyword_counts(F.col("text"), CATALOGUE).items()))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zäöüßéèêàçñóíúáâîôû]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'der', 'que')) AS w FROM documents), g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS gram, i FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)),
 c AS (SELECT doc_id, gram, count(*) AS count, min(i) AS first FROM g GROUP BY 1, 2) SELECT doc_id, gram, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first) AS rank FROM c QUALIFY rank <= 10""")
def top_bigrams(t):
    return X.top_ngrams(t.documents, 2, 10, ["the", "and", "der", "que"])


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zäöüßéèêàçñóíúáâîôû]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'der', 'que')) AS w FROM documents), c AS (SELECT doc_id, w[i] AS gram, count(*) AS count, min(i) AS first FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) GROUP BY 1, 2)
 SELECT doc_id, gram, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first) AS rank FROM c QUALIFY rank <= 20""")
def top_unigrams(t):
    return X.top_ngrams(t.documents, 1, 20, ["the", "and", "der", "que"])


@query(r"SELECT doc_id, length(regexp_replace(text, '[^äöüÄÖÜß]', '', 'g')) AS umlauts, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 12)) AS long_words, len(regexp_extract_all(text, '(ung|heit|keit)([^a-zäöüß]|$)')) AS suffixes FROM documents")
def language_features(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[äöüÄÖÜß]")).alias("umlauts"), F.size(F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 12)).alias("long_words"), F.regexp_count("text", F.lit(r"(ung|heit|keit)([^a-zäöüß]|$)")).alias("suffixes"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+[.,][0-9]{2}')) AS prices, len(regexp_extract_all(text, '[0-9]{6,}')) AS articles, len(regexp_extract_all(text, '[A-Z]{2,}[0-9]+')) AS codes FROM documents")
def numeric_patterns(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"[0-9]+[.,][0-9]{2}")).alias("prices"), F.regexp_count("text", F.lit("[0-9]{6,}")).alias("articles"), F.regexp_count("text", F.lit("[A-Z]{2,}[0-9]+")).alias("codes"))


@query(r"""SELECT doc_id, len(b) AS n_blocks, round(coalesce(list_avg(b), 0), 8) AS mean_block, coalesce(list_min(b), 0) AS least_block, coalesce(list_max(b), 0) AS greatest_block, round(coalesce(list_avg(list_transform(b, lambda x: x * x)) - list_avg(b) * list_avg(b), 0), 4) AS block_variance, round(coalesce(len(list_filter(b, lambda x: x < 50)) / nullif(len(b), 0), 0), 9) AS short_blocks
 FROM (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''), lambda s: CAST(length(s) AS DOUBLE)) AS b FROM documents)""")
def block_features(t):
    digits = {"n_blocks": 0, "mean_block": 8, "least_block": 0, "greatest_block": 0, "block_variance": 4, "short_blocks": 9}
    return t.documents.select("doc_id", *(F.round(c, digits[k]).alias(k) if digits[k] else c.alias(k) for k, c in X.block_stats(F.col("text")).items()))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[\x00-\x7FäöüÄÖÜß]', '', 'g')) / greatest(length(text), 1), 9) AS odd_ratio, len(regexp_extract_all(text, '[a-z][A-Z]')) AS joins, contains(lower(substr(text, 1, CAST(floor(0.2 * length(text)) AS INT))), 'the') AS head_flag FROM documents")
def layout_quality(t):
    n = F.greatest(F.length("text"), F.lit(1))
    return t.documents.select("doc_id", F.round(F.regexp_count("text", F.lit(r"[^\x00-\x7FäöüÄÖÜß]")) / n, 9).alias("odd_ratio"), F.regexp_count("text", F.lit("[a-z][A-Z]")).alias("joins"), F.lower(F.substring("text", F.lit(1), F.floor(0.2 * F.length("text")).cast("int"))).contains("the").alias("head_flag"))


@query()
def repeated_characters(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"(.)\1{3,}")).alias("repeats"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) - 1 AS weekday, weekofyear(o_orderdate) AS week, quarter(o_orderdate) AS q, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season, month(o_orderdate) = 12 AND day(o_orderdate) BETWEEN 10 AND 26 AS near_christmas FROM orders")
def date_features(t):
    d, m = F.col("o_orderdate"), F.month("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), m.alias("m"), F.day(d).alias("d"), F.weekday(d).alias("weekday"), F.weekofyear(d).alias("week"), F.quarter(d).alias("q"), F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "spring").when(m <= 8, "summer").otherwise("autumn").alias("season"), ((m == 12) & F.day(d).between(10, 26)).alias("near_christmas"))


@query("SELECT l_orderkey, round(sum(e), 2) AS total, round(max(p), 8) AS high, round(min(p), 8) AS low, round(max(p) - min(p), 9) AS span, round(avg(CASE WHEN p > 1000 THEN 1.0 ELSE 0.0 END), 12) AS costly FROM (SELECT l_orderkey, l_extendedprice AS e, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1")
def pricing_features(t):
    p = F.try_divide("l_extendedprice", "l_quantity")
    return t.lineitem.withColumn("p", p).groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.max("p"), 8).alias("high"), F.round(F.min("p"), 8).alias("low"), F.round(F.max("p") - F.min("p"), 9).alias("span"), F.round(F.avg((F.col("p") > 1000).cast("double")), 12).alias("costly"))


@query("WITH s AS (SELECT l_orderkey, p_type AS c, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT l_orderkey, arg_max(c, (n, c)) AS dominant, count(*) AS diversity, max(n) AS most, sum(n) AS items FROM s GROUP BY 1")
def product_features(t):
    s = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", F.col("p_type").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("l_orderkey").agg(F.max_by("c", F.struct("n", "c")).alias("dominant"), F.count(F.lit(1)).alias("diversity"), F.max("n").alias("most"), F.sum("n").alias("items"))


@query("SELECT o_orderkey, substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)), 1, 16) AS cache_key, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) AS document_id FROM orders")
def cache_keys(t):
    return t.orders.select("o_orderkey", F.substring(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256), 1, 16).alias("cache_key"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16).alias("document_id"))


LONG_SQL = r"""long AS (SELECT doc_id, unnest(['chars', 'digits', 'bars', 'constant']) AS feature, unnest([CAST(length(text) AS DOUBLE), CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE), CAST(length(regexp_replace(text, '[^|]', '', 'g')) AS DOUBLE), 1.0]) AS value FROM documents)"""


def long_features(t):
    values = {"chars": F.length("text").cast("double"), "digits": F.regexp_count("text", F.lit("[0-9]")).cast("double"), "bars": F.regexp_count("text", F.lit(r"\|")).cast("double"), "constant": F.lit(1.0)}
    return t.documents.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()))).alias("f")).select("doc_id", "f.feature", "f.value")


@query(f"WITH {LONG_SQL} SELECT feature, count(*) AS n, round(var_pop(value), 4) AS variance FROM long GROUP BY 1 HAVING var_pop(value) > 0.01")
def features_by_variance(t):
    return X.variance_of(long_features(t)).where("variance > 0.01").withColumn("variance", F.round("variance", 4))


@query(f"WITH {LONG_SQL} SELECT feature, round(corr(value, quality), 8) AS r FROM long JOIN labels USING (doc_id) WHERE feature <> 'constant' GROUP BY 1")
def features_by_correlation(t):
    d = long_features(t).join(t.labels.select("doc_id", F.col("quality").cast("double").alias("target")), "doc_id").where("feature <> 'constant'")
    return X.correlation_with(d).withColumn("r", F.round("r", 8))


@query(f"WITH {LONG_SQL} SELECT feature, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 8) AS mean FROM long GROUP BY 1")
def feature_analysis(t):
    return long_features(t).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 8).alias("mean"))


@query("SELECT a.vec_id AS query_id, count(*) AS n, round(max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 8) AS best FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1")
def cosine_search(t):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    best = N.nearest(q, t.embeddings, 1, exact=True).select("query_id", F.round("similarity", 8).alias("best"))
    return best.join(F.broadcast(t.embeddings.agg((F.count(F.lit(1)) - 1).alias("n"))), how="cross")


KNN = "knn AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


@query(f"WITH {KNN} SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM knn) WHERE rank <= 5 AND s >= 0.1")
def neighbours_then_filter(t):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return N.nearest(q, t.embeddings, 5, exact=True).where("similarity >= 0.1").select("query_id", "vec_id", "rank")


@query(f"WITH {KNN} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM knn WHERE s >= 0.1 AND label < 5 QUALIFY rank <= 5")
def filter_then_neighbours(t):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return N.nearest(q, t.embeddings, 5, where="label < 5", exact=True).where("similarity >= 0.1").select("query_id", "vec_id", "rank")


@query()
def bucketed_neighbours(t):
    """filter_then_neighbours without its least similarity, through random-projection buckets."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return N.nearest(q, t.embeddings, 5, where="label < 5").select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("WITH q AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT count(*) AS n FROM embeddings WHERE label < 5) SELECT count(*) AS queries, CAST(sum(least(5, n - CASE WHEN label < 5 THEN 1 ELSE 0 END)) AS BIGINT) AS neighbours, TRUE AS found_95_percent FROM q, n")
def neighbour_recall(t):
    """Whether the buckets find 95 % of what the exact search finds."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = stored(N.nearest(q, t.embeddings, 5, where="label < 5", exact=True))
    reached = N.recall_of(N.nearest(q, t.embeddings, 5, where="label < 5"), exact) >= 0.95
    return exact.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours")).withColumn("found_95_percent", F.lit(reached))


@query(f"WITH {KNN}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM knn QUALIFY rank <= 5), w AS (SELECT query_id, CAST(label AS VARCHAR) AS account, sum(s) AS w FROM top GROUP BY 1, 2) SELECT query_id, arg_max(account, (w, account)) AS account, round(least(0.95, max(w) / sum(w)), 6) AS confidence FROM w GROUP BY 1")
def neighbour_vote(t):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    n = N.nearest(q, t.embeddings, 5, exact=True).withColumn("account", F.col("label").cast("string")).withColumn("confidence", F.lit(1.0))
    return R.vote(n).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {KNN}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM knn QUALIFY rank <= 5),
 w AS (SELECT query_id, label, sum(s) AS w, min(rank) AS seen FROM top GROUP BY 1, 2), best AS (SELECT *, max(w) OVER q AS best, sum(w) OVER q AS total FROM w WINDOW q AS (PARTITION BY query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, seen) = 1),
 sup AS (SELECT query_id, label, 's' || CAST(vec_id % 3 AS VARCHAR) AS supplier, count(*) AS n FROM top GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY n DESC, supplier) = 1)
 SELECT query_id, CAST(label AS VARCHAR) AS account, 'c' || CAST(label AS VARCHAR) AS category, round(least(0.95, best / total), 6) AS confidence, supplier, (SELECT string_agg(CAST(t.vec_id AS VARCHAR), ',' ORDER BY t.rank) FROM top t WHERE t.query_id = best.query_id AND t.rank <= 3) AS examples, 'rag_similarity' AS method FROM best JOIN sup USING (query_id, label)""")
def neighbour_vote_details(t):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    name = F.col("label").cast("string")
    n = N.nearest(q, t.embeddings, 5, exact=True).select("query_id", "rank", "similarity", name.alias("account"), F.concat(F.lit("c"), name).alias("category"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("supplier"), F.col("vec_id").cast("string").alias("example"), F.lit(1.0).alias("confidence"))
    return R.vote_details(q, n).withColumn("confidence", F.round("confidence", 6)).withColumn("examples", F.array_join("examples", ","))


@query()
def text_encoder(t):
    return V.encode_texts(t.documents.select("doc_id", "text")).select("doc_id", F.size("vector").alias("dimension"), F.exists("vector", lambda x: x != 0).alias("filled"))


@query()
def category_model(t):
    """Sizes of a split by id and the accuracy of a quality model on the smaller part."""
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("category")).where("category IS NOT NULL").withColumn("training", T.for_training("doc_id"))
    model = T.train_categories(d.where("training").drop("training"), features=4096)
    scores = T.model_scores(T.confusion(T.predicted(model, d.where("NOT training").drop("training"))))
    return scores.select(F.col("validation_examples").alias("test_rows"), "accuracy").join(F.broadcast(d.agg(F.count_if("training").alias("train_rows"))), how="cross")


@query("WITH g AS (SELECT doc_id, n_chars // 500 AS s FROM documents), p AS (SELECT doc_id, n_chars // 450 AS s FROM documents WHERE n_chars >= 100) SELECT count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS hits, count(*) FILTER (p.doc_id IS NULL) AS missed, count(*) FILTER (g.doc_id IS NULL) AS wrong FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.s = p.s")
def span_evaluation(t):
    g = t.documents.select(F.col("doc_id").alias("gd"), F.expr("n_chars div 500").alias("gs"))
    p = t.documents.where("n_chars >= 100").select(F.col("doc_id").alias("pd"), F.expr("n_chars div 450").alias("ps"))
    return g.join(p, (F.col("gd") == F.col("pd")) & (F.col("gs") == F.col("ps")), "full").agg(F.count_if(F.col("gd").isNotNull() & F.col("pd").isNotNull()).alias("hits"), F.count_if(F.col("pd").isNull()).alias("missed"), F.count_if(F.col("gd").isNull()).alias("wrong"))


@query(f"WITH {LONG_SQL} SELECT feature, round(var_pop(value), 4) AS importance FROM long GROUP BY 1 ORDER BY importance DESC, feature LIMIT 2")
def top_features(t):
    return X.variance_of(long_features(t)).select("feature", F.round("variance", 4).alias("importance")).orderBy(F.desc("importance"), "feature").limit(2)
