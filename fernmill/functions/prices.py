"""Price, score and distance expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernmill.functions import fixed
from fernmill.functions.fixed import rx
from fernmill.functions.text import let, matches, strings, text_or_empty

MONEY = "decimal(18,4)"
PRICE = r"\$\s*(\d+(?:\.\d{1,2})?)"


def format_price(amount: Column) -> Column:
    """``$8`` for whole amounts, else ``$8.50``."""
    value = amount.cast(MONEY)
    whole = F.concat(F.lit("$"), value.cast("decimal(18,0)").cast("string"))
    return F.when(value == F.floor(value), whole).otherwise(F.concat(F.lit("$"), value.cast("decimal(18,2)").cast("string")))


def promotional_prices(text: Column) -> Column:
    """Distinct prices in order, as amounts; prices given for comparison don't count."""
    cleaned = F.regexp_replace(text_or_empty(text), rx(fixed.COMPARISON_PRICE), "")
    return F.array_distinct(F.transform(F.regexp_extract_all(cleaned, F.lit(PRICE), F.lit(1)), lambda x: x.cast(MONEY)))


def price_range(prices: Column) -> Column:
    """One price, or the lowest and the highest; null for none."""
    low, high = F.array_min(prices), F.array_max(prices)
    return F.when(F.size(prices) == 0, F.lit(None)).when(low == high, format_price(low)).otherwise(F.concat(format_price(low), F.lit("-"), format_price(high)))


# What an offer's text says it is worth, the most telling first. In
# a label, {n} is a matched number as it is and {$n} one as a price.
VALUE_RULES = [
    (r"\b(\d{1,3})\s*%\s*off\b", "{1}% off"),
    (r"\b(?:half[ -]priced?|1/2\s*off)\b", "50% off"),
    (r"\b(?:bogo|buy\s+one.{0,40}get\s+one|2-4-1)\b", "BOGO"),
    (r"\b(?:2\s*[- ]?for\s*[- ]?1|two\s+for\s+one)\b", "2-for-1"),
    (r"\$\s*(\d+(?:\.\d{1,2})?)\s*off\b", "{$1} off"),
    (r"\$\s*(\d+(?:\.\d{1,2})?)\s*(?:[-–—]|\bto\b)\s*\$?\s*(\d+(?:\.\d{1,2})?)", "{$1}-{$2}"),
    (r"\bfree\b", "Free"),
    (r"\b(?:starting\s+at|from)\s*\$\s*(\d+(?:\.\d{1,2})?)", "{$1}+"),
    (r"\$\s*(\d+(?:\.\d{1,2})?)\s+or\s+less\b", "{$1} or less"),
]
_SLOT = re.compile(r"\{(\$?)(\d)\}")


def value_label(summary: Column, details: Column, evidence: Column, text: Column) -> Column:
    """What an offer is worth: the first rule that its text meets, else its prices."""

    def label(pattern: str, template: str) -> Column:
        parts: list[Column] = []
        at = 0
        for m in _SLOT.finditer(template):
            value = F.regexp_extract(text, rx(pattern), int(m[2]))
            parts += [F.lit(template[at : m.start()]), format_price(value) if m[1] else value]
            at = m.end()
        return F.concat(*parts, F.lit(template[at:]))

    found = [F.when(matches(text, p), label(p, t)) for p, t in VALUE_RULES]
    said = [price_range(promotional_prices(x)) for x in (summary, F.array_join(strings(details), " "), F.array_join(strings(evidence), " "))]
    return F.coalesce(*found, *said)


def _any(tags: Column, *wanted: str) -> Column:
    return F.arrays_overlap(strings(tags), F.array(*map(F.lit, wanted)))


def _points(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def quality_score(text: Column, tags: Column, label: Column, days: Column, window: Column, evidence: Column, confidence: Column) -> Column:
    """0 to 100: what an offer tells and how well it is supported."""
    score = (
        F.lit(25)
        + _points(_any(tags, "percent_off", "bogo", "free"), 25)
        + _points(label.isNotNull(), 15)
        + _points(_any(tags, "happy_hour", "weekday_special"), 10)
        + _points(F.size(strings(days)) > 0, 8)
        + _points(text_or_empty(window) != "", 7)
        + _points(F.size(strings(evidence)) > 0, 5)
        + F.when(confidence.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * 5, 0).cast("int")).otherwise(0)
        - _points(~matches(text, fixed.CONCRETE), 15)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def deal_score(quality: Column, tags: Column, days: Column, window: Column) -> Column:
    """An offer's rank within its place."""
    return (
        F.coalesce(quality, F.lit(0))
        + _points(_any(tags, "happy_hour"), 4)
        + _points(_any(tags, "percent_off", "bogo", "free"), 3)
        + _points(F.size(strings(days)) > 0, 2)
        + _points(text_or_empty(window) != "", 1)
    )


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; infinite where a coordinate is missing."""
    rise, run = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = rise * rise + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * run * run
    return F.coalesce(2 * fixed.EARTH_MILES * F.asin(F.sqrt(h)), F.lit(float("inf")))


def distance_label(distance: Column) -> Column:
    return F.when(distance < 10, F.format_string("%.1f mi", distance)).when(distance < float("inf"), F.format_string("%.0f mi", distance))


def axis(start: Column, end: Column, step: Column) -> Column:
    """Values from ``start`` to ``end``, both included, with slack for rounding."""
    steps = F.floor((end + 1e-6 - start) / step).cast("int")
    return F.when(steps >= 0, F.transform(F.sequence(F.lit(0), steps), lambda i: F.round(start + i * step, 6))).otherwise(F.array().cast("array<double>"))


def compact_number(n: Column) -> Column:
    """1234 as 1.2K."""
    short = lambda x, unit: F.concat(F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit(unit))
    value = F.coalesce(n, F.lit(0)).cast("double")
    return F.when(value >= 1e9, short(value / 1e9, "B")).when(value >= 1e6, short(value / 1e6, "M")).when(value >= 1e3, short(value / 1e3, "K")).otherwise(short(value, ""))


def contrast(pixels: Column, background: Column, quantile: float = 0.4, least: float = 90.0) -> Column:
    """Whether a logo's pixels (arrays of r, g, b) stand out: a quantile of their distances to the background."""
    square = lambda a, b: (a - b) * (a - b)
    distances = F.array_sort(F.transform(pixels, lambda p: F.sqrt(square(p[0], background[0]) + square(p[1], background[1]) + square(p[2], background[2]))))
    return let(distances, lambda d: F.coalesce(F.get(d, F.floor(F.size(d) * F.lit(quantile)).cast("int")) >= least, F.lit(False)))
