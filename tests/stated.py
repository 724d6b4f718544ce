"""Registered queries over inline values, each beside the results stated for it.

What no table of the test data exercises is run here on small inputs. The SQL
holds the expected results as plain values, written from the rules and not from
the library's patterns, so that a wrong pattern cannot be wrong on both sides.
Rows are (rule, case, result); a result is JSON of the value under ``v``.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmill.functions import dates, html, prices, urls
from fernmill.functions import text as T
from fernmill.operators import dedupe, discovery, queues, reports, serve, state, windows
from fernmill.operators import offers as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LIST = "array<string>"
WEEK = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NOON = dt.datetime(2024, 1, 30, 15, 30)  # a Tuesday


def _json(value: object) -> str:
    bare = lambda x: {k: bare(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [bare(v) for v in x] if isinstance(x, list) else x
    return json.dumps(bare({"v": value}), separators=(",", ":"), ensure_ascii=False)


def _shown(v: Column) -> Column:
    return F.to_json(F.struct(v.alias("v")))


def _sql(rows: list[tuple[str, str, object]]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return 'SELECT * FROM (VALUES {}) AS t(rule, "case", result)'.format(", ".join(f"({quote(r)}, {quote(c)}, {quote(_json(v))})" for r, c, v in rows))


Rule = tuple[str, str, Callable[..., Column], list[tuple[tuple, object]]]


def _register(name: str, rules: list[Rule]) -> None:
    """One query of rules (rule, schema of a, b, ..., function of the columns, cases of inputs and result)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for rule, schema, fn, cases in rules:
            kinds = schema.split(";")
            names = [f"c{i}" for i in range(len(kinds))]
            df = spark.createDataFrame([(str(i), *x) for i, (x, _) in enumerate(cases)], "case string, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
            part = df.select(F.lit(rule).alias("rule"), "case", _shown(fn(*map(F.col, names))).alias("result"))
            out = part if out is None else out.unionAll(part)
        return out

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = _sql([(rule, str(i), y) for rule, _, _, cases in rules for i, (_, y) in enumerate(cases)])


def _ones(*pairs: tuple) -> list[tuple[tuple, object]]:
    return [((x,), y) for x, y in pairs]


HOURS = "map<string,array<struct<open:string,close:string>>>"

_register(
    "stated_text",
    [
        ("T07", LIST, T.dedupe_lines, _ones(([" Half off! ", "half  off", "Free soup", ""], ["Half off!", "Free soup"]), ([], []))),
        ("T11", "string;array<string>;array<string>", T.deal_text, [(("Lunch", ["soup"], ["$5 lunch"]), "Lunch soup $5 lunch"), (("Lunch", [], []), "Lunch")]),
        ("T18", "string", T.clean_tier, _ones(("$8: $8 Parmesan Garlic Fries; $8 Buffalo Cauliflower", "$8: Parmesan Garlic Fries; Buffalo Cauliflower"), ("$8 fries", "$8 fries"))),
        ("T19", "string", T.report_fields, _ones(("### Restaurant\nJoe's <!-- hint -->\n\n### City\nIrvine\n### Restaurant\nMoe's\n", {"city": "Irvine", "restaurant": "Moe's"}))),
        ("T21 tag", "string", T.tag_label, _ones(("happy_hour", "Happy Hour"), ("bogo", "Bogo"))),
        ("T21 initials", "string", T.initials, _ones(("Joe's Diner", "JD"), ("", "RD"), ("uno", "U"))),
        ("T21 restaurant", "string;string", T.restaurant_label, [(("Sushi - Irvine", "Irvine"), "Sushi"), (("Sushi", "Irvine"), "Sushi")]),
        ("T22 street", "string", T.street, _ones(("12 Main St Ste 4, X", "Main St"), ("3 Pacific Coast Hwy, X", "PCH"), (None, ""))),
        ("T23", "string;string", T.city_of_address, [(("1 A St, Irvine, CA 9", "Irvine"), "Irvine"), (("1 A St, Tustin, CA", "Irvine"), None), (("", "Irvine"), "Irvine")]),
        ("T24", "string", dates.evidence_has_time, _ones(("MON-FRI 3-6:30", True), ("Choose any 3-6 appetizers", False), ("until 6 p.m.", True), ("all day", True))),
    ],
)
_register(
    "stated_dates",
    [
        ("D05", "string", dates.evidence_days, _ones(("Mondays and weekdays", WEEK[:5]), ("weekdays and Saturday", WEEK[:6]), ("Sat through Mon", ["monday", "saturday", "sunday"]), ("seven days", WEEK), ("", []))),
        ("D07", "string", dates.month_days, _ones(("29th of each month", [29]), ("every 15th and each 3rd of the month", [3, 15]), ("every 45th", []), (None, []))),
        ("D09", "string", lambda c: F.transform(dates.time_ranges(c), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), _ones(("3 PM - 6 PM", ["900-1080"]), ("11-2 pm", ["660-840"]), ("9 PM - close", ["1260-1440"]), ("10 pm to 1 am", ["1320-1500"]), ("anytime", []))),
        ("D12", "string;string", dates.shared_schedule, [(("MON-FRI 3-6:30 SAT + SUN 1-5", "Social Hour"), "Mon-Fri 3pm-6:30pm; Sat-Sun 1pm-5pm"), (("Monday through Friday 3pm-6pm", "Lunch"), "Mon-Fri 3pm-6pm")]),
        ("D14", "string", dates.schedule_text, _ones(("Monday - Friday 3:00 PM to 6:30 p.m.", "Mon-Fri 3pm-6:30pm"), ("Sat 9 AM", "Sat 9am"))),
        ("D15", "string;string", dates.is_redundant, [(("Mon-Fri, 3 PM - 6 PM", "Mon-Fri 3pm to 6pm happy hour"), True), (("Tue", "Mon"), False), (("Check source", ""), True)]),
        (
            "D17",
            f"array<string>;array<int>;string;{HOURS}",
            lambda d, m, w, h: dates.available_now(d, m, w, h, F.lit(NOON)),
            [
                (([], [], "3 PM - 6 PM", None), True), ((["monday"], [], None, None), False), (([], [], "Mon 3-6 pm; Tue 9-11 am", None), False), (([], [], "Mon-Thu 3 PM - 5 PM; Fri-Sat 8:30 PM - 10 PM", None), True), (([], [], "sometime", None), True), (([], [], "all day", None), True),
                ((["tuesday"], [], "9 AM - 11 AM", None), False), ((["tuesday"], [], "3:30 PM - 4 PM", None), True),
            ],
        ),
        ("D18", f"{HOURS};timestamp", dates.open_status, [(({"monday": [{"open": "11:00", "close": "14:00"}], "sunday": [{"open": "20:00", "close": "02:00"}]}, dt.datetime(2024, 1, 29, 1, 0)), "Open until 2am"), ((None, NOON), "Hours unknown")]),
        ("N01", "string", prices.format_price, _ones(("8", "$8"), ("8.5", "$8.50"), ("8.00", "$8"), ("1999.99", "$1999.99"))),
        ("N11", "double", prices.compact_number, _ones((1234.0, "1.2K"), (999.0, "999"), (2_000_000.0, "2M"))),
    ],
)
_register(
    "stated_urls",
    [
        ("U06", "string", urls.published_url, _ones(("http://www.Example.com//specials/", "https://example.com/specials"), ("https://x.com:8080/a?b=1#c", "https://x.com:8080/a?b=1"), ("ftp://x.com", ""), (None, ""))),
        ("U09", "string", urls.is_blocked, _ones(("https://m.facebook.com/x", True), ("https://notfacebook.com", False))),
        ("U10", "string", urls.is_safe, _ones(("https://example.com", True), ("http://localhost/x", False), ("file:///etc", False), ("http://10.0.0.1/", False), ("http://a.local", False))),
        ("U11 type", "binary;string", urls.sniff_type, [((bytearray(b"%PDF-1.4"), ""), "application/pdf"), ((bytearray(b"\x89PNG\r\n\x1a\nxx"), "text/html"), "image/png"), ((bytearray(b"RIFF0000WEBPxx"), ""), "image/webp"), ((bytearray(b"abc"), "image/gif; q=1"), "image/gif"), ((bytearray(b""), ""), "")]),
        ("U11 extension", "binary;string", urls.image_extension, [((bytearray(b"\x89PNG\r\n\x1a\nxx"), "text/html"), "png"), ((bytearray(b"RIFF0000WEBPxx"), ""), "webp")]),
        ("H09 color", "string", urls.brand_color, _ones(("#FFF", None), ("#123", "#112233"), ("rgb(1, 2, 300)", "#0102ff"), ("red", None), ("#fded00", "#fded00"), ("#f0f0f0", None))),
        ("O07", "string;string;string;int;int", queues.reusable_text, [(("h", "h", "ok", None, None), True), (("h", "h", "ok", 7, 7), True), (("h", "h", "ok", 7, None), False), (("", "", "ok", None, None), False), (("h", "g", "ok", None, None), False), (("h", "h", "pending", None, None), False)]),
    ],
)

_PAGE = """<html><head><link rel="icon" href="/i.png" sizes="32x32"><link rel="apple-touch-icon" href="/a.png" sizes="180x180"><meta property="og:image" content="/og.jpg">
<meta name="theme-color" content="#123"><script>var a = "<p>no</p>"</script></head><body><img class="logo" src="/logo.svg"><img src="/happy-hour-menu.jpg" alt="Happy Hour" width="800" height="600">
<p>One &amp; two<br>three</p><a href="/specials">Daily <b>Specials</b></a><a href="menu.pdf"></a><iframe>hidden</iframe></body></html>"""
_HOME = "https://example.com"
_register(
    "stated_html",
    [
        ("H01", "string", html.visible_lines, _ones((_PAGE, ["One & two", "three", "Daily", "Specials"]), (None, []))),
        ("H04", "string", html.links, _ones((_PAGE, [{"href": "/specials", "label": "Daily Specials"}, {"href": "menu.pdf", "label": ""}]))),
        ("H07", "string;string", lambda u, p: F.transform(F.slice(html.assets(u, p), 1, 1), lambda a: F.struct(a["url"].alias("url"), a["score"].alias("score"))), [((f"{_HOME}/x", _PAGE), [{"url": f"{_HOME}/happy-hour-menu.jpg", "score": 15}])]),
        ("H08", "string;string", html.icons, [((f"{_HOME}/x", _PAGE), [f"{_HOME}/{x}" for x in ("logo.svg", "a.png", "og.jpg", "i.png", "favicon.ico")])]),
        ("H09", "string", html.theme_colors, _ones((_PAGE, ["#123"]))),
        ("S17 locations", "string", html.locations, _ones(("<urlset xmlns='x'><url><loc>https://a.com/m</loc></url></urlset>", ["https://a.com/m"]), ("<broken", []))),
    ],
)


def _stated(name: str, expected: list[tuple[str, str, object]]) -> Callable[[Callable[[SparkSession], list[tuple[str, DataFrame, Column, Column]]]], None]:
    """One query of operators, given as (rule, result table, case, value)."""

    def add(parts: Callable[[SparkSession], list[tuple[str, DataFrame, Column, Column]]]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = None
            for rule, df, case, value in parts(spark):
                part = df.select(F.lit(rule).alias("rule"), case.cast("string").alias("case"), _shown(value).alias("result"))
                out = part if out is None else out.unionAll(part)
            return out

        run.__name__ = name
        QUERIES[name] = run
        SQL[name] = _sql(expected)

    return add


_OFFER = "id string, ord int, restaurant string, city string, summary string, details array<string>, source_evidence array<string>, time_window string, source_url string, first_seen string"


def _offer(i: int, place: str, summary: str, details: list[str] | None = None, window: str | None = None, url: str = "https://a.com", seen: str = "2024-01-01T00:00:00Z") -> tuple:
    return (str(i), i, place, "X", summary, details or [], [], window, url, seen)


@_stated(
    "stated_merge",
    [
        ("A01", "2", {"urls": ["https://a.com/2", "https://a.com"], "seen": "2023-12-01T00:00:00Z", "merged": ["1"]}),
        *(("A01", i, {"urls": ["https://a.com"], "seen": "2024-01-01T00:00:00Z", "merged": []}) for i in ("3", "4", "5", "6", "9", "10")),
        ("A01", "8", {"urls": ["https://a.com"], "seen": "2024-01-01T00:00:00Z", "merged": ["7"]}),
        ("A08", "0", {"summary": "Lunch bowl $9", "window": None, "details": [], "categories": ["food"], "until": None, "grouped": None}),
        ("A08", "1", {"summary": "$8-$13 Social Hour", "window": "Mon-Fri 3pm-6:30pm; Sat-Sun 1pm-5pm", "details": ["$8: $8: fries; soup", "$10: sliders", "$13: cocktails", "Dine in only"], "categories": ["food", "drink"], "until": "2030-01-01", "grouped": 3}),
    ],
)
def _merge(spark: SparkSession) -> list[tuple[str, DataFrame, Column, Column]]:
    """Duplicates of a place merge into the richer record; a page's price tiers become one offer."""
    rows = [
        _offer(1, "A", "Feast Special for $49"), _offer(2, "A", "Feast Special for $49", ["serves four", "with salad"], url="https://a.com/2", seen="2023-12-01T00:00:00Z"),
        _offer(3, "B", "Happy hour", window="3pm-6pm"), _offer(4, "B", "Happy hour", window="9pm-11pm"), _offer(5, "C", "Lunch special $9"), _offer(6, "C", "Dinner special $9"),
        _offer(7, "D", "$49 Family Feast bundle for four"), _offer(8, "D", "Family Feast bundle serving four $49"), _offer(9, "E", "$8 tacos"), _offer(10, "E", "$9 burgers"),
    ]
    made = dedupe.greedy_merge(spark.createDataFrame(rows, _OFFER))
    shown = F.struct(F.col("source_urls").alias("urls"), F.col("first_seen").alias("seen"), F.col("merged_ids").alias("merged"))
    # An offer that merged with none keeps its own address.
    shown = F.struct(F.when(F.size(F.coalesce("source_urls", F.array().cast(LIST))) > 0, F.col("source_urls")).otherwise(F.array("source_url")).alias("urls"), shown["seen"].alias("seen"), shown["merged"].alias("merged"))
    schema = "page string, ord int, summary string, details array<string>, applies_days array<string>, applies_month_days array<int>, time_window string, categories array<string>, valid_through string, source_evidence array<string>, ai_confidence double"
    when = ["MON-FRI 3-6:30 SAT + SUN 1-5"]
    tiers = [
        ("p", 0, "Lunch bowl $9", [], ["monday"], [], None, ["food"], None, [], 0.9), ("p", 1, "$8 Social Hour Food", ["$8: $8 fries; $8 soup"], [], [], None, ["food"], None, when, 0.95),
        ("p", 2, "$10 Social Hour", ["sliders"], ["monday"], [], None, ["food"], None, [], 0.9), ("p", 3, "$13 Social Hour and Drinks", ["cocktails", "Dine in only"], [], [], None, ["drink"], "2030-01-01", [], 0.99),
    ]
    one = dedupe.consolidate(spark.createDataFrame(tiers, schema))
    fields = F.struct("summary", F.col("time_window").alias("window"), "details", "categories", F.col("valid_through").alias("until"), F.col("grouped_deals").alias("grouped"))
    return [("A01", made, F.col("id"), shown), ("A08", one, F.col("ord"), fields)]


@_stated(
    "stated_offers",
    [
        *(("P02", str(i), y) for i, y in enumerate([True, False, False, True, False, False])),
        ("W01", "Free dessert with purchase", True), ("W01", "Happy hour $5 beers", True),
        ("H11", "https://www.a.com/happy-hour", "high site_link"), ("H11", "https://www.a.com/specials", "medium site_link"), ("H11", "https://a.com/happy-hour", "high sitemap"), ("H11", "https://a.com/weekday-specials", "high sitemap"), ("H11", "https://www.a.com/", "medium page_text"),
        ("H12", "https://b.com/deals", "Deals known_path"),
        ("J01", "p", {"status": "BUSINESS_STATUS_UNSPECIFIED", "sunday": [{"open": "09:00", "close": "17:30"}]}),
    ],
)
def _made(spark: SparkSession) -> list[tuple[str, DataFrame, Column, Column]]:
    """Evidence checks of extracted offers, candidates of a page's lines, pages and places found."""
    schema = "i int, summary string, details array<string>, evidence array<string>, applies_days array<string>, applies_month_days array<int>, categories array<string>, time_window string, valid_through string, confidence double, context string"
    context = "1. $6 beers every Tuesday from 3pm to 6pm\n2. Lunch or dinner for just $1.99"
    row = lambda i, s, e, c=0.95, t="none": (i, s, [], [e], ["tuesday", "friday"], [], ["drink"], "3pm-6pm", t, c, context)
    asked = [row(0, "$6 beers", "$6 BEERS every tuesday"), row(1, "$6 beers", "$7 beers every Tuesday"), row(2, "$6 beers", "$6 beers every Tuesday", 0.5), row(3, "Lunch for just $1.99", "Lunch or dinner for just $1.99"), row(4, "$6 beers", "$6 beers every Tuesday", t="2020-01-01"), row(5, "Menu", "$6 beers every Tuesday")]
    judged = O.judge_extracted(spark.createDataFrame(asked, schema), F.lit(NOON))
    lines = ["Welcome to our place", "Happy hour $5 beers", "Mon-Fri 3-6 pm", "Dine in only", "Copyright us", "Free dessert with purchase"]
    found = windows.candidates(spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, pos int, line string"), "doc").where("summary in ('Happy hour $5 beers', 'Free dessert with purchase')").select("summary").distinct()
    page = '<a href="/happy-hour">Join us</a><a href="https://other.com/deals">Deals</a><a href="/specials-menu">Specials menu</a><a href="specials">Our specials</a>'
    sitemap = '<urlset xmlns="x"><url><loc>https://a.com/menu</loc></url><url><loc>https://a.com/happy-hour</loc></url><url><loc>https://a.com/weekday-specials</loc></url></urlset>'
    linked = discovery.discover(spark.createDataFrame([("https://www.a.com/", page)], "url string, html string"), spark.createDataFrame([("https://www.a.com/", sitemap)], "url string, xml string"))
    probes = spark.createDataFrame([("https://b.com/", "https://b.com/deals", "<p>Happy hour!</p>"), ("https://b.com/", "https://b.com/specials", "<p>no</p>")], "site string, url string, html string")
    probed = discovery.discover(spark.createDataFrame([("https://b.com/", "")], "url string, html string"), probes=probes)
    raw = {"id": "p", "displayName": {"text": "Uno"}, "formattedAddress": "1 A St, Irvine, CA 92618", "location": {"latitude": 33.6, "longitude": -117.8}, "regularOpeningHours": {"periods": [{"open": {"day": 0, "hour": 9}, "close": {"day": 0, "hour": 17, "minute": 30}}, {"open": {"day": 1, "hour": 9}}]}}
    places = discovery.places(spark.createDataFrame([(json.dumps(x), "Irvine") for x in (raw, raw | {"id": "q", "formattedAddress": "1 A St, Tustin, CA"}, {"id": ""})] + [("broken", "Irvine")], "json string, city string"))
    return [
        ("P02", judged, F.col("i"), F.col("accepted")),
        ("W01", found, F.col("summary"), F.lit(True)),
        ("H11", linked, F.col("url"), F.concat_ws(" ", "confidence", "discovered_via")),
        ("H12", probed, F.col("url"), F.concat_ws(" ", "label", "discovered_via")),
        ("J01", places, F.col("place_id"), F.struct(F.col("business_status").alias("status"), F.col("hours")["sunday"].alias("sunday"))),
    ]


@_stated(
    "stated_reports",
    [
        ("P07", "https://uno.com/deals", True), ("J10", "https://uno.com/deals", "reported"), ("J10", "https://uno.com/s", "medium"),
        ("A05", "all", {"restaurants": 2, "operational": 1, "with_website": 1, "with_specials": 2, "specials_pages": 3, "cities": 2}), ("P08", "p", True),
        ("A06", "u1", "curated 3"), ("A06", "u2", "failed 0"), ("X05", "p", "https://n"), ("X05", "q", "https://duo.com/deals"),
        ("D22", "b", "2024-01-08"), ("D22", "c", "2024-01-15"), ("A09", "p Beers", True), ("A09", "p Other", True), ("A09", "q Beers", True),
        ("O09", "b", True), ("ST1", "a", "active"), ("ST1", "b", "queued"), ("P04", "d.com", 1), ("P04", "b.com", 2), ("P04", "kfc.com", 3),
    ],
)
def _told(spark: SparkSession) -> list[tuple[str, DataFrame, Column, Column]]:
    """Summaries, coverage, areas and queues over small tables."""
    page = "struct<url:string,confidence:string,publish:boolean>"
    inv = spark.createDataFrame(
        [(0, "p", "Uno", "X", "OPERATIONAL", "https://uno.com", None, [("https://uno.com/deals", "high", True), ("https://uno.com/s", "medium", True)]), (1, "q", "Duo", "Y", "CLOSED", "", "2024", [("https://duo.com/deals", "high", True)])],
        f"ord int, place_id string, name string, city string, business_status string, website_url string, specials_checked_at string, specials_pages array<{page}>",
    )
    asked = spark.createDataFrame([("p", "Uno", "https://uno.com/deals", 7)], "place_id string, name string, url string, issue int")
    sources = spark.createDataFrame([("Uno", "X", "u1", "curated"), ("Duo", "Y", "u2", "discovered")], "name string, city string, url string, origin string")
    tried = spark.createDataFrame([("u1", 3, None), ("u2", None, "down")], "url string, n int, error string")
    found = spark.createDataFrame([("p", [("https://n", "high", True)], True), ("q", [], False)], f"place_id string, pages array<{page}>, ok boolean")
    areas = spark.createDataFrame([("a", 0, "active", "2024-01-01T00:00:00Z"), ("b", 1, "queued", None), ("c", 2, "queued", None)], "city string, ord int, status string, activated_at string")
    deal = "struct<summary:string,source_evidence:array<string>>"
    deals = [("p", "Uno", "b", "high", "ok", [("Happy hour", ["$5 Beers!"]), ("Other", [])]), ("p", "Uno", "a", "reported", "ok", [("Beers", ["$5 beers"])]), ("q", "Duo", "c", "high", "ok", [("Beers", ["$5 beers"])])]
    unique = reports.unique_extracted(spark.createDataFrame(deals, f"place_id string, name string, url string, confidence string, status string, deals array<{deal}>"))
    seen = "2026-09-10T16:26:21Z"
    states = spark.createDataFrame([("a", 0, "active", seen, seen), ("b", 1, "queued", None, None)], "city string, ord int, status string, activated_at string, last_refreshed string")
    due = state.due_areas(states, F.lit(dt.datetime(2026, 9, 17, 14, 37)))
    fresh = state.area_states(spark.createDataFrame([("a", 0), ("b", 1)], "city string, ord int"), None, spark.createDataFrame([("a",)], "city string"), F.lit(seen))
    logos = [("kfc.com", True, False, None, None), ("a.com", False, False, "missing", "2024-01-20T00:00:00Z"), ("b.com", True, True, "ok", "2023-01-01T00:00:00Z"), ("c.com", True, False, "ok", "2024-01-01T00:00:00Z"), ("d.com", True, False, "missing", "2024-01-01T00:00:00Z")]
    queue = queues.logo_queue(spark.createDataFrame(logos, "host string, active boolean, has_logo boolean, status string, checked_at string"), F.lit(NOON))
    return [
        ("P07", reports.publishable_pages(inv), F.col("url"), F.lit(True)),
        ("J10", reports.candidate_pages(asked, inv), F.col("url"), F.col("confidence")),
        ("A05", reports.coverage(inv), F.lit("all"), F.struct("restaurants", "operational", "with_website", "with_specials", "specials_pages", "cities")),
        ("P08", reports.source_refresh(inv), F.col("place_id"), F.lit(True)),
        ("A06", reports.source_status(sources, tried, F.lit(NOON)), F.col("url"), F.concat_ws(" ", "mode", F.col("candidate_count").cast("string"))),
        ("X05", reports.with_found_pages(inv, found, F.lit(NOON)), F.col("place_id"), F.col("specials_pages")[0]["url"]),
        ("D22", reports.activation_estimates(areas).where("expected_at is not null"), F.col("city"), F.date_format("expected_at", "yyyy-MM-dd")),
        ("A09", unique, F.concat_ws(" ", "place_id", "deal.summary"), F.lit(True)),
        ("O09", due, F.col("city"), F.lit(True)),
        ("ST1", fresh, F.col("city"), F.col("status")),
        ("P04", _placed(spark, queue), F.col("host"), F.col("at")),
    ]


def _placed(spark: SparkSession, queue: DataFrame) -> DataFrame:
    """The hosts of a bounded queue with their places, so that the order is compared too."""
    return spark.createDataFrame([(r["host"], i + 1) for i, r in enumerate(queue.collect())], "host string, at int")


_FEED = [("KFC", "A", "deal", ["food"], ["monday"], "active"), ("Uno", "A", "happy hour", ["drink"], [], "active"), ("Duo", "B", "soup", ["general"], ["tuesday"], "active"), ("Old", "B", "x", ["food"], [], "stale")]
_ASKED: list[tuple[str, dict, list[str]]] = [
    ("any day", {"day": ""}, ["Duo", "KFC", "Uno"]), ("today", {}, ["Duo", "Uno"]), ("monday", {"day": "monday"}, ["KFC", "Uno"]), ("food", {"day": "", "types": ("food",)}, ["KFC"]), ("no type", {"day": "", "types": ()}, []), ("happy hour", {"day": "", "kinds": ("happy_hour",)}, ["Uno"]),
    ("no chains", {"day": "", "chains": False}, ["Duo", "Uno"]), ("words", {"day": "", "query": "SOUP"}, ["Duo"]), ("city", {"day": "", "cities": ("B",)}, ["Duo"]), ("favorites", {"day": "", "favorites_only": True, "favorites": ("Uno|A",)}, ["Uno"]), ("radius without a place", {"day": "", "radius": 3}, []),
]


@_stated("stated_serving", [("P01", case, names) for case, _, names in _ASKED])
def _served(spark: SparkSession) -> list[tuple[str, DataFrame, Column, Column]]:
    """Every filter of the serving query, one at a time."""
    feed = spark.createDataFrame(_FEED, "restaurant string, city string, summary string, categories array<string>, applies_days array<string>, status string")
    return [("P01", serve.select(feed, serve.QuerySpec(**asked), F.lit(NOON)).agg(F.array_sort(F.collect_list("restaurant")).alias("names")), F.lit(case), F.col("names")) for case, asked, _ in _ASKED]
