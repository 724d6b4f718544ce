"""Text expressions: keys, tags, categories, predicates and labels of offers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernmill.functions import fixed
from fernmill.functions.fixed import rx

STRINGS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def some_text(value: Column) -> Column:
    """Null for an empty string: a missing value either way."""
    return F.nullif(value, F.lit(""))


def some_list(value: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(value) > 0, value)


def strings(value: Column) -> Column:
    return F.coalesce(value, F.array().cast(STRINGS))


def matches(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(rx(pattern)), F.lit(False))


def normalize_line(value: Column) -> Column:
    """White space collapsed, decoration at the ends removed; entities are decoded before (see ``html``)."""
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(" -|•\t"))


def normalized_key(value: Column) -> Column:
    """Lower case, with everything but letters, digits, $ and % as single spaces."""
    return F.trim(F.regexp_replace(F.lower(normalize_line(value)), "[^a-z0-9$%]+", " "))


def folded_text(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text_or_empty(value), r"(?U)\s+", " ")))


def word_key(value: Column) -> Column:
    """Lower case, with what is not a word character as single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_]+", " "))


def restaurant_key(name: Column, city: Column) -> Column:
    """Name without common words, and city; the same place under different spellings."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    plain = F.regexp_replace(plain, r"\b(?:restaurant|bar|grill|cafe|the)\b", "")
    return F.concat_ws("|", F.trim(F.regexp_replace(plain, " +", " ")), F.lower(city))


def detect_tags(text: Column) -> Column:
    """Tags whose pattern the text matches, in their fixed order."""
    return F.array_compact(F.array(*(F.when(matches(text, p), F.lit(tag)) for tag, p in fixed.TAGS.items())))


def categories(text: Column) -> Column:
    found = F.array_compact(F.array(F.when(matches(text, fixed.FOOD), F.lit("food")), F.when(matches(text, fixed.DRINK), F.lit("drink"))))
    return let(found, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit("general"))))


def dedupe_lines(lines: Column) -> Column:
    """Normalized lines, the first of those whose words agree."""
    pairs = F.transform(F.filter(lines, lambda x: F.length(normalize_line(x)) > 0), lambda x: F.struct(word_key(normalize_line(x)).alias("key"), normalize_line(x).alias("line")))

    def firsts(p: Column) -> Column:
        keys = F.transform(p, lambda x: x["key"])
        return F.transform(F.filter(p, lambda x, i: F.array_position(keys, x["key"]) == i + 1), lambda x: x["line"])

    return let(pairs, firsts)


def is_noise(line: Column) -> Column:
    return reduce(lambda a, b: a | b, (matches(line, p) for p in fixed.NOISE)) | F.coalesce(line.rlike(fixed.NOISE_NAME), F.lit(False))


def starts_offer(line: Column) -> Column:
    return F.coalesce(line.rlike(r"^\$ ?\d"), F.lit(False)) | matches(line, fixed.STARTS_OFFER) | matches(line, fixed.TAGS["percent_off"]) | matches(line, fixed.TAGS["bogo"])


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def is_quality_candidate(text: Column, summary: Column, tags: Column, days: Column) -> Column:
    """Not noise, not a bare heading, not too long, and a price only where words promote it.

    ``days`` are the days that the summary names.
    """
    bare = (word_count(summary) < 2) & ~summary.startswith("$") & (F.size(days) == 0)
    unpromoted = F.array_contains(tags, "dollar_amount") & ~matches(text, fixed.PROMO_CONTEXT)
    price_only = (tags == F.array(F.lit("dollar_amount"))) & ~matches(text, r"\b(?:off|each|starting at|special|deal|coupon|happy hour)\b")
    return ~is_noise(text) & ~matches(summary, fixed.LOW_VALUE_SUMMARY) & ~bare & (F.length(text) <= 320) & ~unpromoted & ~price_only


def has_discount(text: Column, tags: Column) -> Column:
    telling = F.array(*map(F.lit, ("percent_off", "bogo", "happy_hour", "free")))
    return F.arrays_overlap(strings(tags), telling) | matches(text, fixed.EXPLICIT_DISCOUNT)


def deal_text(summary: Column, details: Column, evidence: Column) -> Column:
    """Everything an offer says, as one line."""
    return normalize_line(F.concat_ws(" ", summary, strings(details), strings(evidence)))


def search_text(*parts: Column) -> Column:
    """Lower-case text that searches look into; missing parts are skipped."""
    return F.lower(F.concat_ws(" ", *parts))


def dines(categories_: Column) -> Column:
    return F.arrays_overlap(strings(categories_), F.array(F.lit("food"), F.lit("drink")))


def is_verified(text: Column, candidate: Column, summary: Column, tags: Column, categories_: Column, scheduled: Column, notes: Column) -> Column:
    """Whether an offer proves to be one: a discount, a scheduled price, a named special or a concrete promotion."""
    priced = scheduled & dines(categories_) & F.coalesce(text.rlike(r"\$\s*\d+(?:\.\d{1,2})?"), F.lit(False))
    named = scheduled & dines(categories_) & matches(summary, fixed.NAMED_SPECIAL) & F.lower(text_or_empty(notes)).contains("special")
    concrete = matches(text, fixed.CONCRETE) & (dines(categories_) | scheduled)
    return (F.length(text) > 0) & ~matches(text, fixed.NOT_DINING) & (has_discount(text_or_empty(candidate), tags) | priced | named | concrete)


def is_publishable(candidate: Column, tags: Column, categories_: Column, days: Column) -> Column:
    """Whether an offer from a discovered page may be shown."""
    priced = (F.size(strings(days)) > 0) & F.array_contains(strings(tags), "dollar_amount") & dines(categories_) & matches(text_or_empty(candidate), fixed.PROMO_CONTEXT)
    return has_discount(text_or_empty(candidate), tags) | priced


def _words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("[a-z0-9]+"), F.lit(0))


def signature(summary: Column) -> Column:
    """Words of a promotion without prices, percentages and filler."""
    text = F.regexp_replace(F.lower(text_or_empty(summary)), r"\$\s*\d+(?:\.\d{1,2})?(?:\s*[-–—]\s*\$?\s*\d+(?:\.\d{1,2})?)?", " ")
    text = F.regexp_replace(text, r"\b\d+(?:\.\d+)?\s*(?:percent|%)\b", " ")
    return F.array_join(F.filter(_words(text), lambda w: ~w.isin(fixed.SIGNATURE_STOP)), " ")


def duplicate_tokens(summary: Column) -> Column:
    return F.array_distinct(F.filter(_words(F.lower(text_or_empty(summary))), lambda w: ~w.isin(fixed.SIGNATURE_STOP) & (F.length(w) > 1)))


def variants(summary: Column) -> Column:
    """Days and meals that a summary names."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(summary)), F.lit(fixed.VARIANT), F.lit(0)))


def family(summary: Column) -> Column:
    """A promotion's name apart from its prices."""
    text = F.regexp_replace(summary, r"\$\s*\d+(?:\.\d{1,2})?", " ")
    return F.lower(normalize_line(F.regexp_replace(text, rx(r"\b(?:food|drinks?|and|items?|offers?|menu)\b"), " ")))


def clean_tier(detail: Column) -> Column:
    """``$8: $8 fries; $8 soup`` with the price once."""
    price = F.regexp_extract(detail, r"^(\$\s*\d+(?:\.\d{1,2})?):\s*(.+)$", 1)
    body = F.regexp_extract(detail, r"^(\$\s*\d+(?:\.\d{1,2})?):\s*(.+)$", 2)
    bare = lambda x: F.when(x.startswith(price) & F.substring(x, F.length(price) + 1, F.lit(1)).rlike(r"\s"), F.ltrim(F.substring(x, F.length(price) + 1, F.length(x)))).otherwise(x)
    items = F.array_join(F.transform(F.split(body, r";\s*"), bare), "; ")
    return F.when(price != "", F.concat(price, F.lit(": "), items)).otherwise(detail)


def report_fields(body: Column) -> Column:
    """``### Heading`` sections of a form as a map; comments go, the last of equal headings wins."""
    pattern = r"(?m)^###\s+(.+?)\s*$\n([\s\S]*?)(?=^###\s+|\z)"
    heads = F.regexp_extract_all(text_or_empty(body), F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text_or_empty(body), F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(F.transform(heads, folded_text).alias("k"), F.transform(values, lambda v: F.btrim(F.regexp_replace(v, r"(?s)<!--.*?-->", ""), F.lit(" \n\r\t"))).alias("v"))
    # A later entry with the same key takes the place of an earlier one.
    last = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"])))
    return F.map_from_entries(last)


def safe_filename(host: Column, extension: Column) -> Column:
    stem = F.btrim(F.regexp_replace(F.lower(host), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat_ws(".", F.coalesce(some_text(stem), F.lit("restaurant")), extension)


def tag_label(tag: Column) -> Column:
    upper_first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    return F.array_join(F.transform(F.split(tag, "_"), upper_first), " ")


def category_label(categories_: Column) -> Column:
    has = lambda c: F.array_contains(strings(categories_), c)
    return F.when(has("food") & has("drink"), "Food + drink").when(has("food"), "Food").when(has("drink"), "Drink").otherwise("General")


def restaurant_label(name: Column, city: Column) -> Column:
    suffix = F.concat(F.lit(" - "), city)
    return F.when((F.length(city) > 0) & F.endswith(name, suffix), F.substring(name, F.lit(1), F.length(name) - F.length(suffix))).otherwise(name)


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(text_or_empty(name), "[^A-Za-z0-9' ]", " "), r"\s+"), lambda w: w != "")
    return F.coalesce(some_text(F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))), F.lit("RD"))


def location_key(restaurant: Column, address: Column, city: Column) -> Column:
    return F.concat(text_or_empty(restaurant), F.lit("|"), F.coalesce(some_text(address), city, F.lit("")))


def slug(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "-"), "^-|-$", "")


def street(address: Column) -> Column:
    """The street of an address without number and suite, to tell places of one name apart."""
    line = F.regexp_replace(F.split_part(text_or_empty(address), F.lit(","), F.lit(1)), r"^\d+\s+", "")
    line = F.trim(F.regexp_replace(line, r"(?i)\s+(?:Ste|Suite|Unit|#)\s*\S+.*$", ""))
    return F.when(line.rlike(r"(?i)^(?:CA-1|Pacific Coast (?:Hwy|Highway))$"), "PCH").otherwise(line)


def city_of_address(address: Column, expected: Column) -> Column:
    """``expected`` if the address is empty or names it in its state, else null."""
    there = F.regexp_like(text_or_empty(address), F.concat(F.lit(r"(?iU)\b\Q"), expected, F.lit(r"\E\s*,\s*CA\b")))
    return F.when(there | (text_or_empty(address) == ""), expected)
