"""Schedule expressions: days, clock times, windows, opening hours and feed timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernmill.functions import fixed
from fernmill.functions.fixed import DAYS, SHORT_DAYS, rx
from fernmill.functions.text import STRINGS, let, matches, normalize_line, some_text, strings, text_or_empty

DASH = r"\s*(?:-|to|thru|through|–|—)\s*"
#: A day's name or short form; the first three letters tell which day it is.
DAY = r"(mon(?:day)?|tues?|tuesday|wed(?:nesday)?|thu(?:r|rs|rsday)?|thursday|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
DAY_WORD = "(" + "|".join(sorted((x for forms in fixed.DAY_FORMS.values() for x in forms), key=lambda x: (-len(x), x))) + ")"
WEEK_MINUTES = 7 * 1440


def days_literal(days: list[str]) -> Column:
    return F.array(*map(F.lit, days)) if days else F.array().cast(STRINGS)


def day_number(form: Column) -> Column:
    """0 for Monday to 6, by the first three letters of a day's name."""
    short = F.array(*(F.lit(d[:3]) for d in DAYS))
    return (F.array_position(short, F.lower(F.substring(form, 1, 3))) - 1).cast("int")


def _span(first: Column, last: Column) -> Column:
    """Day numbers from one day to another, over the week's end if need be."""
    return F.transform(F.sequence(first, F.when(last >= first, last).otherwise(last + 7)), lambda i: i % 7)


def _name(number: Column) -> Column:
    return F.element_at(days_literal(DAYS), number + 1)


def _ranges(text: Column, day: str, dash: str) -> Column:
    pattern = F.lit(rf"\b{day}{dash}{day}\b")
    a, b = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.flatten(F.zip_with(a, b, lambda x, y: _span(day_number(x), day_number(y))))


def extract_days(text: Column) -> Column:
    """Days that a text names, in its order: daily, else weekdays, else the weekend, else ranges and single days."""
    lower = F.lower(text_or_empty(text))
    to = r"\s*(?:-|to|thru|through|–|—)\s*"
    named = F.array_distinct(F.concat(_ranges(lower, DAY, DASH), F.transform(F.regexp_extract_all(lower, F.lit(rf"\b{DAY}\b"), F.lit(1)), day_number)))
    return (
        F.when(matches(lower, r"\b(?:daily|every day|everyday)\b"), days_literal(DAYS))
        .when(matches(lower, rf"\b(?:weekday|weekdays|monday{to}friday|mon{to}fri|m\s*-\s*f)\b"), days_literal(DAYS[:5]))
        .when(matches(lower, r"\b(?:weekend|weekends)\b"), days_literal(DAYS[5:]))
        .otherwise(F.transform(named, _name))
    )


def evidence_days(text: Column) -> Column:
    """Days that evidence supports, Monday first: weekdays, weekend, ranges and single days together."""
    lower = F.lower(text_or_empty(text))
    number = lambda days: F.array(*map(F.lit, days)) if days else F.array().cast("array<int>")
    week = F.when(matches(lower, r"\bweekdays?\b"), number([0, 1, 2, 3, 4])).otherwise(number([]))
    end = F.when(matches(lower, r"\bweekends?\b"), number([5, 6])).otherwise(number([]))
    single = F.transform(F.regexp_extract_all(lower, F.lit(rf"\b{DAY_WORD}\b"), F.lit(1)), day_number)
    spans = _ranges(lower, rf"{DAY_WORD}\b", r"\s*(?:-|–|—|to|through|thru)\s*\b")
    found = F.array_sort(F.array_distinct(F.concat(week, end, single, spans)))
    return F.when(matches(lower, r"\b(?:every\s*day|everyday|daily|seven days|7 days)\b"), days_literal(DAYS)).otherwise(F.transform(found, _name))


def evidence_has_time(text: Column) -> Column:
    """Whether evidence gives a clock time, says all day or closing, or has a bare range after a day."""
    lower = F.lower(text_or_empty(text))
    return (
        matches(lower, r"\b\d{1,2}(?::\d{2})?\s*(?:a\.?m\.?|p\.?m\.?)\b")
        | matches(lower, r"\b(?:all day|open|close|closing)\b")
        | matches(lower, rf"\b{DAY_WORD}\b[^\n]{{0,24}}\d{{1,2}}(?::\d{{2}})?\s*(?:-|–|—|to)\s*\d{{1,2}}(?::\d{{2}})?")
    )


def segment_days(segment: Column, correct: bool = True) -> Column:
    """Days of one segment of a time window; empty if it names none.

    ``correct`` reads whole day names and ranges over the week's end. Without
    it, only the first range that doesn't wrap, short forms and names that are a
    short form plus "day" count.
    """
    lower = F.lower(text_or_empty(segment))
    if correct:
        return evidence_days(lower)
    short = "(mon|tue|wed|thu|fri|sat|sun)"
    pattern = rf"\b{short}\s*[-–—]\s*{short}\b"
    first, last = day_number(F.regexp_extract(lower, pattern, 1)), day_number(F.regexp_extract(lower, pattern, 2))
    inside = lambda i: (first >= 0) & (last >= 0) & (first <= i) & (i <= last)
    return F.array_compact(F.array(*(F.when(inside(F.lit(i)) | matches(lower, rf"\b{d[:3]}(?:day)?\b"), F.lit(d)) for i, d in enumerate(DAYS))))


def month_days(text: Column) -> Column:
    """Days of the month that recur, ascending."""
    of_month = F.regexp_extract_all(text_or_empty(text), F.lit(rx(r"\b(\d{1,2})(?:st|nd|rd|th)\s+of\s+(?:each|every|the)\s+month\b")), F.lit(1))
    every = F.regexp_extract_all(text_or_empty(text), F.lit(rx(r"\b(?:every|each)\s+(\d{1,2})(?:st|nd|rd|th)(?:\s+of\s+(?:the\s+)?month)?\b")), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(of_month, every), lambda x: x.cast("int")), lambda x: x.between(1, 31))))


def recurring_month_days(explicit: Column, text: Column) -> Column:
    valid = F.filter(explicit, lambda x: x.between(1, 31))
    return let(valid, lambda own: F.when(F.size(own) > 0, F.array_sort(F.array_distinct(own))).otherwise(month_days(text)))


def _clock(hour: Column, minute: Column, period: Column) -> Column:
    base = F.concat(hour.cast("int").cast("string"), F.when(minute != "", F.concat(F.lit(":"), minute)).otherwise(F.lit("")))
    return F.when(F.lower(period) == "close", "close").when(period != "", F.concat(base, F.lit(" "), F.upper(period))).otherwise(base)


def time_window(text: Column, correct: bool = False) -> Column:
    """First clock range of a text as ``3 PM - 6 PM``; null without one.

    A start without a period takes the end's. With ``correct`` it takes the other
    one if it would otherwise follow the end ("11-2 pm" starts in the morning).
    """
    part = lambda i: F.regexp_extract(text_or_empty(text), rx(fixed.TIME_RANGE), i)
    given, end = part(3), part(6)
    inherited = F.when(F.lower(end) == "close", "").otherwise(end)
    if correct:
        wraps = (F.lower(end) == "pm") & (part(1).cast("int") % 12 > part(4).cast("int") % 12)
        inherited = F.when(wraps, "am").otherwise(inherited)
    start = F.when(given != "", given).otherwise(inherited)
    window = F.concat(_clock(part(1), part(2), start), F.lit(" - "), _clock(part(4), part(5), end))
    return F.when(part(1) != "", window).when(matches(text_or_empty(text), r"\bafter\s+5\s*pm\b"), F.lit("After 5 PM"))


def _minutes(hour: Column, minute: Column, period: Column) -> Column:
    h = hour.cast("int")
    h = F.when((period == "pm") & (h < 12), h + 12).when((period == "am") & (h == 12), F.lit(0)).otherwise(h)
    return h * 60 + F.coalesce(some_text(minute).cast("int"), F.lit(0))


def clock_minutes(clock: Column) -> Column:
    """Minutes of a ``HH:MM`` clock."""
    return F.split_part(clock, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(clock, F.lit(":"), F.lit(2)).cast("int")


def time_ranges(value: Column, closes_at: Column | None = None) -> Column:
    """All clock ranges as (start, end) minutes; an end not after its start is on the next day.

    ``close`` is the business's closing minute, midnight where it is not known.
    """
    pattern = F.lit(r"(?i)(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*(?:-|to|–|—)\s*(?:(\d{1,2})(?::(\d{2}))?\s*(am|pm)?|(close))")
    group = lambda i: F.transform(F.regexp_extract_all(text_or_empty(value), pattern, F.lit(i)), lambda x: F.lower(x))
    rows = F.arrays_zip(*(group(i).alias(f"g{i}") for i in range(1, 8)))
    closing = F.coalesce(closes_at, F.lit(1440)) if closes_at is not None else F.lit(1440)

    def one(m: Column) -> Column:
        flips = (m["g1"].cast("int") > m["g4"].cast("int")) & (m["g6"] == "pm")
        start_period = F.when(m["g3"] != "", m["g3"]).when(m["g6"] == "", F.lit("")).when(flips, F.lit("am")).otherwise(m["g6"])
        end_period = F.when(m["g6"] != "", m["g6"]).otherwise(start_period)
        start = _minutes(m["g1"], m["g2"], start_period)
        end = F.when(m["g7"] != "", closing).otherwise(_minutes(m["g4"], m["g5"], end_period))
        return F.struct(start.alias("start"), F.when(end <= start, end + 1440).otherwise(end).alias("end"))

    return F.transform(rows, one)


def day_label(days: Column) -> Column:
    """``Every day``, ``Mon-Fri``, ``Weekend`` or the days; null for none."""
    short = F.transform(days, lambda d: F.element_at(days_literal(SHORT_DAYS), day_number(d) + 1))
    return (
        F.when(days == days_literal(DAYS), "Every day")
        .when(days == days_literal(DAYS[:5]), "Mon-Fri")
        .when(days == days_literal(DAYS[5:]), "Weekend")
        .when(F.size(days) > 0, F.array_join(short, ", "))
    )


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def validity(days: Column, window: Column, recurring: Column | None = None) -> Column:
    """How an offer's schedule reads; the days are left out where the window has them."""
    recurring = recurring if recurring is not None else F.array().cast("array<int>")
    monthly = F.when(F.size(recurring) > 0, F.concat(F.lit("Every month on the "), F.array_join(F.transform(recurring, ordinal), ", ")))
    in_window = F.size(extract_days(window)) > 0
    label = F.when(~in_window, day_label(days))
    return F.coalesce(some_text(F.concat_ws(", ", monthly, label, some_text(window))), F.lit("Check source"))


def shared_schedule(value: Column, promotion: Column) -> Column:
    """A schedule in short: day abbreviations, ranges with a dash, pm for the hours of a happy or social hour."""
    out = normalize_line(text_or_empty(value))
    for day, short in zip(DAYS, SHORT_DAYS, strict=True):
        out = F.regexp_replace(out, rx(rf"\b(?:{'|'.join(fixed.DAY_FORMS[day])})\b"), short)
    names = "|".join(SHORT_DAYS)
    out = F.regexp_replace(out, rx(r"\b(Sat)\s*\+\s*(Sun)\b"), "$1-$2")
    out = F.regexp_replace(out, rx(rf"\b({names})\s+(?:through|thru|to)\s+({names})\b"), "$1-$2")
    # Bare ranges of an hour promotion are afternoons; leading zeros go.
    bare = rx(r"\b0*(\d{1,2})((?::\d{2})?)\s*(?:-|–|—|to)\s*0*(\d{1,2})((?::\d{2})?)\b(?!\s*(?:am|pm))")
    out = F.when(matches(text_or_empty(promotion), r"\b(?:happy|social)\s+hour\b"), F.regexp_replace(out, bare, "$1$2pm-$3$4pm")).otherwise(out)
    out = F.regexp_replace(out, r"\s*;\s*", "; ")
    out = F.regexp_replace(out, rx(rf"(?<=pm)\s+(?=(?:{names})\b)"), "; ")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" ,;-"))


def best_schedule(candidates: Column) -> Column:
    """Of texts with days and a clock range, the one with most days, then the longest, then the first; null for none."""
    useful = F.filter(candidates, lambda x: (F.size(evidence_days(x)) > 0) & x.rlike(r"\d{1,2}(?::\d{2})?\s*(?:-|–|—|to)\s*\d{1,2}(?::\d{2})?"))
    ranked = F.transform(useful, lambda x, i: F.struct(F.size(evidence_days(x)).alias("days"), F.length(x).alias("length"), (-i).alias("place"), x.alias("text")))
    return F.array_max(ranked)["text"]


def schedule_text(value: Column) -> Column:
    """Canonical display of a schedule."""
    out = text_or_empty(value)
    for day, short in zip(DAYS, SHORT_DAYS, strict=True):
        out = F.regexp_replace(out, rf"(?i)\b{day}\b", short)
    out = F.regexp_replace(out, r"(?i)\b0?(\d{1,2})(?::00)?\s*([ap])\.?m\b\.?", "$1$2m")
    out = F.regexp_replace(out, r"(?i)\b0?(\d{1,2}:\d{2})\s*([ap])\.?m\b\.?", "$1$2m")
    out = F.regexp_replace(F.regexp_replace(out, r"(\d)AM\b", "$1am"), r"(\d)PM\b", "$1pm")
    out = F.regexp_replace(F.regexp_replace(out, r"(\d)Am\b", "$1am"), r"(\d)Pm\b", "$1pm")
    out = F.regexp_replace(out, r"(?i)(\d(?:am|pm))\s+(?:to|[-–—])\s+(?=\d)", "$1-")
    names = "|".join(SHORT_DAYS)
    out = F.regexp_replace(out, rf"\b({names})\s*[-–—]\s*({names})\b", "$1-$2")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([,;])", "$1"), r"\s{2,}", " "))


def schedule_signals(value: Column) -> Column:
    """Days, clock times and all-day words of a schedule."""
    lower = F.lower(schedule_text(value))
    every = lambda p: F.regexp_extract_all(lower, F.lit(p), F.lit(0))
    return F.array_distinct(F.concat(every(r"\b(?:mon|tue|wed|thu|fri|sat|sun)\b"), every(r"\b\d{1,2}(?::\d{2})?(?:am|pm)\b"), every(r"\b(?:all day|every day|daily)\b")))


def is_redundant(validity_: Column, visible: Column) -> Column:
    """Whether what is shown already says all that the validity says."""
    signals = schedule_signals(validity_)
    text = schedule_text(validity_)
    return (text == "") | (F.lower(text) == "check source") | ((F.size(signals) > 0) & (F.size(F.array_except(signals, schedule_signals(visible))) == 0))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def earliest() -> Column:
    """Before any time that was noted."""
    return F.to_timestamp(F.lit("0001-01-01 00:00:00"))


def parse_iso(value: Column, fallback: Column | None = None) -> Column:
    """A timestamp from ISO text, else ``fallback``, else null.

    First and last sightings fall back on a time at hand, activations on none,
    and checks on :func:`earliest`, so that they are due.
    """
    parsed = F.try_to_timestamp(value)
    return F.coalesce(parsed, fallback) if fallback is not None else parsed


def parse_date(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))))


def today_name(now: Column) -> Column:
    return F.lower(F.date_format(now, "EEEE"))


def matches_day(days: Column, day: Column) -> Column:
    """No days match every day, and all seven match any."""
    # Bound once: a filter moves below the projection that derives the days, and would derive them at every mention.
    return let(strings(days), lambda own: (F.size(own) == 0) | F.array_contains(own, day) | (F.size(F.array_except(days_literal(DAYS), own)) == 0))


def matches_month_day(recurring: Column, now: Column) -> Column:
    return let(recurring, lambda own: (F.size(own) == 0) | F.array_contains(own, F.dayofmonth(now)))


def week_minute(now: Column) -> Column:
    return F.weekday(now) * 1440 + F.hour(now) * 60 + F.minute(now)


def open_ranges(hours: Column) -> Column:
    """(start, end, open, close) in minutes of the week from a map of days to clock ranges."""

    def of_day(number: int, day: str) -> Column:
        def minutes(r: Column) -> Column:
            opens, closes = clock_minutes(r["open"]), clock_minutes(r["close"])
            end = F.when(closes <= opens, closes + 1440).otherwise(closes)
            return F.struct((opens + number * 1440).alias("start"), (end + number * 1440).alias("end"), r["open"].alias("open"), r["close"].alias("close"))

        return F.transform(F.coalesce(hours[day], F.array().cast("array<struct<open:string,close:string>>")), minutes)

    return F.concat(*(of_day(i, d) for i, d in enumerate(DAYS)))


def format_clock(clock: Column) -> Column:
    hour, minute = F.split_part(clock, F.lit(":"), F.lit(1)).cast("int"), F.split_part(clock, F.lit(":"), F.lit(2)).cast("int")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    return F.concat(shown, F.when(minute != 0, F.concat(F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))).otherwise(F.lit("")), F.when(hour >= 12, "pm").otherwise("am"))


def open_status(hours: Column, now: Column, correct: bool = True) -> Column:
    """``Open until``, ``Closed now, opens``, ``Closed today`` or ``Hours unknown``.

    Ranges that run past Sunday's end are met by testing a week later; without
    ``correct`` a day later is tested instead.
    """
    minute, shift = week_minute(now), WEEK_MINUTES if correct else 1440
    inside = lambda r: ((minute >= r["start"]) & (minute < r["end"])) | ((minute + shift >= r["start"]) & (minute + shift < r["end"]))
    current = F.get(F.filter(open_ranges(hours), inside), F.lit(0))
    today = F.get(F.coalesce(hours[today_name(now)], F.array().cast("array<struct<open:string,close:string>>")), F.lit(0))
    return (
        F.when(hours.isNull(), "Hours unknown")
        .when(current.isNotNull(), F.concat(F.lit("Open until "), format_clock(current["close"])))
        .when(today.isNotNull(), F.concat(F.lit("Closed now, opens "), format_clock(today["open"])))
        .otherwise("Closed today")
    )


def available_now(days: Column, recurring: Column, window: Column, hours: Column, now: Column, correct: bool = True) -> Column:
    """Whether an offer holds at ``now``; a window that can't be read counts as holding."""
    today, minute = today_name(now), F.hour(now) * 60 + F.minute(now)
    last = F.element_at(F.coalesce(F.when(F.size(hours[today]) > 0, hours[today]), F.array(F.struct(F.lit("00:00").alias("open"), F.lit("24:00").alias("close")))), -1)
    closes = clock_minutes(last["close"])
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def segment(s: Column) -> Column:
        own = segment_days(s, correct)
        other = (F.size(own) > 0) & ~F.array_contains(own, today)
        ranges = F.when(other, empty).otherwise(time_ranges(s, closes))
        return F.struct((F.size(own) > 0).alias("scheduled"), (F.size(ranges) > 0).alias("parsed"), F.exists(ranges, lambda r: (minute >= r["start"]) & (minute < r["end"])).alias("hit"))

    def judged(parts: Column) -> Column:
        return F.exists(parts, lambda p: p["hit"]) | ~F.exists(parts, lambda p: p["scheduled"] | p["parsed"])

    in_window = let(F.transform(F.split(text_or_empty(window), r"\s*;\s*"), segment), judged)
    anytime = (text_or_empty(window) == "") | matches(text_or_empty(window), r"\ball day\b")
    closed = open_status(hours, now, correct).startswith("Closed")
    return matches_month_day(recurring, now) & matches_day(days, today) & ~closed & (anytime | in_window)


def is_new(first_seen: Column, now: Column) -> Column:
    """Discovered in the last week; a day ahead of the clock is tolerated."""
    age = F.unix_timestamp(now) - F.unix_timestamp(first_seen)
    return F.coalesce((age >= -86400) & (age <= fixed.NEW_DEAL_DAYS * 86400), F.lit(False))


def display_date(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    return F.coalesce(F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "MMM d, h:mm a"), F.lit(" PT")), F.lit("never"))


def ordinal_day(day: Column) -> Column:
    """Days since the start of year 1, which is day 1."""
    return F.datediff(day, F.lit("0001-01-01")) + 1


def pivot_hours(periods: Column) -> Column:
    """A map of days to clock ranges from periods (Sunday is 0); incomplete periods go."""
    clock = lambda p: F.format_string("%02d:%02d", p["hour"].cast("int"), F.coalesce(p["minute"].cast("int"), F.lit(0)))
    whole = F.filter(periods, lambda p: p["open"]["day"].isNotNull() & p["open"]["hour"].isNotNull() & p["close"]["hour"].isNotNull())
    number = lambda p: (p["open"]["day"].cast("int") + 6) % 7
    order = F.array_distinct(F.transform(whole, number))
    entry = lambda d: F.struct(_name(d).alias("key"), F.transform(F.filter(whole, lambda p: number(p) == d), lambda p: F.struct(clock(p["open"]).alias("open"), clock(p["close"]).alias("close"))).alias("value"))
    return F.map_from_entries(F.transform(order, entry))
