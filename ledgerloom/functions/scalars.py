"""Scalar classification and validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?U)"


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str, below: bool = True) -> Column:
    """The label of the first step that x is below (or reaches); otherwise the last one."""
    out = None
    for bound, label in steps:
        test = x < bound if below else x >= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def clean_text(x: Column, most: int = 8192) -> Column:
    kept = F.regexp_replace(x, UNICODE + r"[^\w\s.,\-:äöüÄÖÜß€]", " ")
    return F.substring(F.trim(F.lower(F.regexp_replace(kept, UNICODE + r"\s+", " "))), 1, most)


def price_range(x: Column) -> Column:
    return ladder(x, [(10, "niedrig"), (100, "mittel"), (800, "hoch")], "anlagevermögen")


def total_category(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, "unknown").otherwise(ladder(x, [(50, "small"), (500, "medium"), (2000, "large")], "very_large"))


def total_band(x: Column) -> Column:
    return ladder(x, [(100, "klein"), (1000, "mittel")], "gross")


def quality_band(score: Column) -> Column:
    return ladder(score, [(0.9, "excellent"), (0.8, "high"), (0.65, "good"), (0.5, "medium"), (0.3, "low")], "poor", below=False)


def stored_quality(band: Column) -> Column:
    return F.when(band.isin("high", "medium", "low", "poor"), band).otherwise("medium")


def successful(errors: Column, confidence: Column, quality: Column) -> Column:
    return (errors == 0) & (confidence >= 0.5) & quality.isin("high", "medium")


def cost_estimate(items: Column, cached: Column) -> Column:
    return F.when(cached, 0.0).when(items <= 10, 0.005).when(items <= 50, 0.015).otherwise(0.03)


def size_category(size: Column, cuts: tuple[float, float, float]) -> Column:
    return ladder(size, list(zip(cuts, ("small", "medium", "large"), strict=True)), "huge")


def timeout_factor(category: Column) -> Column:
    return F.when(category == "small", 1.0).when(category == "medium", 1.5).when(category == "large", 3.0).otherwise(6.0)


def valid_vat_rate(x: Column) -> Column:
    return x.isin(0, 7, 19)


def valid_account(x: Column) -> Column:
    return x.rlike("^[0-9]{4}$") & F.coalesce(x.try_cast("int").between(1000, 9999), F.lit(False))


def class_matches(account: Column, klass: Column) -> Column:
    return F.substring(account, 1, 1) == klass.cast("string")


def valid_postcode(x: Column) -> Column:
    return x.rlike("^[0-9]{5}$") & F.coalesce(x.try_cast("int") >= 1000, F.lit(False))


def valid_phone(x: Column) -> Column:
    bare = F.translate(x, " -/", "")
    return (bare.startswith("+49") | bare.startswith("0")) & (F.length(bare) >= 10)


def valid_vat_id(x: Column) -> Column:
    return x.rlike("^DE[0-9]{9}$")


def parse_amount(x: Column) -> Column:
    """Amounts such as "1.234,56 €"; null where it is none."""
    bare = F.trim(F.translate(x, "€", ""))
    german = F.when(bare.contains(","), F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(bare)
    return german.try_cast("double")


def format_currency(x: Column) -> Column:
    return F.concat(F.translate(F.format_number(x, 2), ",.", ".,"), F.lit(" EUR"))


#: Spellings of units and their short forms.
UNITS = {"stück": "Stk", "stk": "Stk", "stck": "Stk", "pcs": "Stk", "meter": "m", "mtr": "m", "m": "m", "kilogramm": "kg", "kg": "kg", "liter": "l", "l": "l"}


def normalize_unit(x: Column, units: dict[str, str] | None = None) -> Column:
    table = F.create_map(*(F.lit(v) for pair in (units or UNITS).items() for v in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(x))), x)


def violations(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that do not hold; a null check does not hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in checks)))


def first_keyword(text: Column, entries: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first entry, in order, whose keyword the text contains."""
    out = None
    for keyword, value in entries:
        out = F.when(text.contains(keyword), value) if out is None else out.when(text.contains(keyword), value)
    return out.otherwise(F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for zero, null or unequal vectors."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
