"""Tables in texts, by tiers: a tier works on the rows in which all earlier ones found nothing.

Everything is a column expression of the row: lines with bars in a stretch are a
table, else the first pattern with enough matches gives one whose columns are
the pattern's groups.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import bind, normalize_headers

TYPE = "array<struct<method: string, table_index: int, headers: array<string>, rows: array<array<string>>, confidence: double>>"


def _table(method: str, index: Column, headers: Column, rows: Column, confidence: float) -> Column:
    return F.struct(F.lit(method).alias("method"), index.cast("int").alias("table_index"), headers.alias("headers"), rows.alias("rows"), F.lit(confidence).alias("confidence"))


def bar_tables(text: Column, confidence: float = 0.9) -> Column:
    """Tables of stretches of lines with bars: the first row is the header, rules of dashes and blank rows go; a header alone is no table."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))
    blank = lambda row: F.forall(row, lambda c: (c == "") | F.regexp_like(c, F.lit("^:?-+:?$")))

    def stretches(lines: Column) -> Column:
        barred = F.transform(lines, lambda line: F.contains(line, F.lit("|")))
        edges = lambda b, step: F.filter(F.transform(b, lambda x, i: F.when(x & ~F.coalesce(F.get(b, i + step), F.lit(False)), i)), lambda i: i.isNotNull())
        parts = lambda b: F.zip_with(edges(b, -1), edges(b, 1), lambda a, z: F.filter(F.transform(F.slice(lines, a + 1, z - a + 1), cells), lambda row: ~blank(row)))
        return bind(barred, parts)

    whole = F.filter(bind(F.split(text, "\n", -1), stretches), lambda rows: F.size(rows) > 1)
    tables = F.transform(whole, lambda rows, i: _table("bars", i, F.get(rows, F.lit(0)), F.slice(rows, 2, F.size(rows) - 1), confidence))
    return F.coalesce(tables, F.array().cast(TYPE))


class TablePattern(NamedTuple):
    """A pattern of one row; headers name its groups, or are made up where empty."""

    regex: str
    groups: int
    headers: tuple[str, ...] = ()


def _row(groups: int):
    return lambda match: F.array(*(match[f"c{g}"] for g in range(1, groups + 1)))


def pattern_tables(text: Column, patterns: list[TablePattern], least_rows: int = 2, least_chars: int = 100, confidence: float = 0.6) -> Column:
    """The table of the first pattern with least_rows matches in a text of least_chars (blanks at its ends aside); its number is the table's."""
    out = F.array().cast(TYPE)
    for k, p in reversed(list(enumerate(patterns))):
        columns = [F.regexp_extract_all(text, F.lit(p.regex), F.lit(g)).alias(f"c{g}") for g in range(1, p.groups + 1)]
        # Every match gives each group once, so the groups' arrays are aligned.
        rows = F.transform(F.arrays_zip(*columns), _row(p.groups))
        headers = F.array(*map(F.lit, p.headers or [f"column_{g}" for g in range(1, p.groups + 1)]))
        out = F.when(F.regexp_count(text, F.lit(p.regex)) >= max(1, least_rows), F.array(_table("pattern", F.lit(k), headers, rows, confidence))).otherwise(out)
    return F.when(F.length(F.trim(text)) >= least_chars, out).otherwise(F.array().cast(TYPE))


def first_tier(tiers: list[Column]) -> Column:
    """The tables of the first tier that finds any in a row; later ones are not computed there."""
    out = F.array().cast(TYPE)
    for tier in reversed(tiers):
        out = F.when(F.size(tier) > 0, tier).otherwise(out)
    return out


def described(table: Column, variants: list[tuple[str, list[str]]]) -> dict[str, Column]:
    """A table's fields with normalised headers and its numbers of rows and columns."""
    return {"method": table["method"], "table_index": table["table_index"], "headers": table["headers"], "normalized_headers": normalize_headers(table["headers"], variants), "rows": table["rows"], "row_count": F.size(table["rows"]), "column_count": F.size(table["headers"]), "confidence": table["confidence"]}


#: What counts most in a document's score, and the fields that count.
TEXT_SHARE, TABLE_SHARE, FIELD_SHARE, PAGE_SHARE = 0.4, 0.2, 0.3, 0.1
FULL_TEXT_CHARS, FULL_TABLES = 5_000, 3
FIELDS = ("invoice_number", "invoice_date", "total_gross", "supplier_name")


def extraction_score(text: Column, tables: Column, fields: Column, pages: Column) -> Column:
    """0 to 1 by the text's length, the number of tables, the four fields that the map has, and pages, as a share of what can be had."""
    n = F.coalesce(F.length(text), F.lit(0))
    found = sum((F.coalesce(F.map_contains_key(fields, F.lit(k)), F.lit(False)).cast("double") for k in FIELDS), F.lit(0.0))
    score = TEXT_SHARE * F.least(n / FULL_TEXT_CHARS, F.lit(1.0)) + TABLE_SHARE * F.least(F.greatest(F.size(tables), F.lit(0)) / FULL_TABLES, F.lit(1.0)) + FIELD_SHARE * found / len(FIELDS) + F.when(pages > 0, PAGE_SHARE).otherwise(0.0)
    return score / (TEXT_SHARE + TABLE_SHARE + FIELD_SHARE + PAGE_SHARE)
