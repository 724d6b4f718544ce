"""Stated results of single operators on inline values."""

import datetime as dt
import ipaddress
import random

from helpers import values
from pyspark.sql import functions as F

from fernmill.functions import dates, fixed, html, prices, urls
from fernmill.functions import text as T

C = F.col
LIST = "array<string>"


def one(spark, value, fn, kind="string"):
    return values(spark, [(value,)], f"x {kind}", y=fn(C("x")))[0]["y"]


def many(spark, pairs, fn, kind="string"):
    found = values(spark, [(x,) for x, _ in pairs], f"x {kind}", y=fn(C("x")))
    assert [r["y"] for r in found] == [y for _, y in pairs]


def label(c):
    empty = F.array().cast(LIST)
    return prices.value_label(c, empty, empty, T.normalize_line(c))


def test_value_label(spark):
    many(
        spark,
        [
            ("Red Hour Happy Hour with $10 cocktails and $10 bites", "$10"),
            ("Thursday $7 Smash Burger (regularly $18)", "$7"),
            ("Small plates $4.00 to $8.00", "$4-$8"),
            ("2-for-1 Happy Hour drinks", "2-for-1"),
            ("Half-Priced Drinks", "50% off"),
            ("$4.20 pints and $6 cocktails", "$4.20-$6"),
            ("25 % off entrees", "25% off"),
            ("Buy one burger get one", "BOGO"),
            ("$5 off any pizza", "$5 off"),
            ("Free dessert", "Free"),
            ("Plates from $8.99", "$8.99+"),
            ("Everything $9 or less", "$9 or less"),
            ("Sunday brunch", None),
        ],
        label,
    )


def test_value_label_falls_back_to_details_and_evidence(spark):
    rows = [("Lunch", ["$9 bowl"], ["$3"]), ("Lunch", [], ["$3 soup", "$5 soup"])]
    text = T.deal_text(C("s"), F.array().cast(LIST), F.array().cast(LIST))
    got = values(spark, rows, "s string, d array<string>, e array<string>", y=prices.value_label(C("s"), C("d"), C("e"), text))
    assert [r["y"] for r in got] == ["$9", "$3-$5"]


def test_tags_and_categories(spark):
    tags = one(spark, "$8-$13 Social Hour", T.detect_tags)
    assert "happy_hour" in tags and "dollar_amount" in tags
    many(spark, [("taco and beer", ["food", "drink"]), ("live music", ["general"])], T.categories)


def test_signature(spark):
    many(spark, [("$8-$13 Social Hour", "social hour"), ("$10 Social Hour Food and Drinks", "social hour"), (None, "")], T.signature)


def test_extract_days(spark):
    week = fixed.DAYS
    many(
        spark,
        [
            ("Daily specials", week),
            ("Mon-Fri 3pm", week[:5]),
            ("weekends only", week[5:]),
            ("Fri-Mon", ["friday", "saturday", "sunday", "monday"]),
            ("Tues & Thurs", ["tuesday", "thursday"]),
            ("Wednesday to Friday", week[2:5]),
            ("mondays", []),
            (None, []),
        ],
        dates.extract_days,
    )


def test_evidence_days(spark):
    week = fixed.DAYS
    many(spark, [("Mondays and weekdays", week[:5]), ("weekdays and Saturday", week[:6]), ("Sat through Mon", ["monday", "saturday", "sunday"]), ("seven days", week), ("", [])], dates.evidence_days)


def test_evidence_has_time(spark):
    many(spark, [("MON-FRI 3-6:30", True), ("Choose any 3-6 appetizers", False), ("until 6 p.m.", True), ("all day", True)], dates.evidence_has_time)


def test_time_window(spark):
    many(spark, [("3-6 pm", "3 PM - 6 PM"), ("3:30pm to 9 close", "3:30 PM - close"), ("from 3:30pm to close", None), ("after 5 pm", "After 5 PM"), ("11-2 pm", "11 PM - 2 PM"), ("no time", None)], dates.time_window)
    assert one(spark, "11-2 pm", lambda c: dates.time_window(c, correct=True)) == "11 AM - 2 PM"


def test_time_ranges(spark):
    pairs = lambda c: F.transform(dates.time_ranges(c), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    many(spark, [("3 PM - 6 PM", ["900-1080"]), ("11-2 pm", ["660-840"]), ("9 PM - close", ["1260-1440"]), ("10 pm to 1 am", ["1320-1500"]), ("anytime", [])], pairs)


def test_validity(spark):
    week = fixed.DAYS
    rows = [(week, "Mon-Fri 3pm-6:30pm; Sat-Sun 1pm-5pm", []), (week, None, []), (week[5:], "3 PM - 6 PM", []), ([], None, []), ([], None, [1, 22, 13])]
    got = values(spark, rows, "d array<string>, w string, m array<int>", y=dates.validity(C("d"), C("w"), C("m")))
    assert [r["y"] for r in got] == ["Mon-Fri 3pm-6:30pm; Sat-Sun 1pm-5pm", "Every day", "Weekend, 3 PM - 6 PM", "Check source", "Every month on the 1st, 22nd, 13th"]


def test_month_days(spark):
    many(spark, [("29th of each month", [29]), ("every 15th and each 3rd of the month", [3, 15]), ("every 45th", []), (None, [])], dates.month_days)


def test_shared_schedule(spark):
    got = values(
        spark,
        [("MON-FRI 3-6:30 SAT + SUN 1-5", "Social Hour"), ("Monday through Friday 3pm-6pm", "Lunch")],
        "s string, p string",
        y=dates.shared_schedule(C("s"), C("p")),
    )
    assert [r["y"] for r in got] == ["Mon-Fri 3pm-6:30pm; Sat-Sun 1pm-5pm", "Mon-Fri 3pm-6pm"]


def test_schedule_display(spark):
    many(spark, [("Monday - Friday 3:00 PM to 6:30 p.m.", "Mon-Fri 3pm-6:30pm"), ("Sat 9 AM", "Sat 9am")], dates.schedule_text)
    got = values(spark, [("Mon-Fri, 3 PM - 6 PM", "Mon-Fri 3pm to 6pm happy hour"), ("Tue", "Mon"), ("Check source", "")], "v string, t string", y=dates.is_redundant(C("v"), C("t")))
    assert [r["y"] for r in got] == [True, False, True]


def test_clean_tier(spark):
    many(spark, [("$8: $8 Parmesan Garlic Fries; $8 Buffalo Cauliflower", "$8: Parmesan Garlic Fries; Buffalo Cauliflower"), ("$8 fries", "$8 fries")], T.clean_tier)


def test_keys_and_labels(spark):
    many(spark, [("The Corner-Bar & Grill", "corner|x"), ("Cafe Uno", "uno|x")], lambda c: T.restaurant_key(c, F.lit("X")))
    many(spark, [("happy_hour", "Happy Hour"), ("bogo", "Bogo")], T.tag_label)
    many(spark, [("Joe's Diner", "JD"), ("", "RD"), ("uno", "U")], T.initials)
    many(spark, [("Sushi - Irvine", "Sushi"), ("Sushi", "Sushi")], lambda c: T.restaurant_label(c, F.lit("Irvine")))
    many(spark, [("12 Main St Ste 4, X", "Main St"), ("3 Pacific Coast Hwy, X", "PCH"), (None, "")], T.street)
    many(spark, [("1 A St, Irvine, CA 9", "Irvine"), ("1 A St, Tustin, CA", None), ("", "Irvine")], lambda c: T.city_of_address(c, F.lit("Irvine")))


def test_dedupe_lines(spark):
    many(spark, [([" Half off! ", "half  off", "Free soup", ""], ["Half off!", "Free soup"]), ([], [])], T.dedupe_lines, LIST)


def test_report_fields(spark):
    body = "### Restaurant\nJoe's <!-- hint -->\n\n### City\nIrvine\n### Restaurant\nMoe's\n"
    assert one(spark, body, T.report_fields) == {"restaurant": "Moe's", "city": "Irvine"}


def test_normalize_is_idempotent(spark):
    lines = ["  - A   b | ", "•x\t", "", "a – b"]
    once = [r["y"] for r in values(spark, [(x,) for x in lines], "x string", y=T.normalize_line(C("x")))]
    many(spark, [(x, x) for x in once], T.normalize_line)


def test_prices(spark):
    many(spark, [("8", "$8"), ("8.5", "$8.50"), ("8.00", "$8"), ("1999.99", "$1999.99")], prices.format_price)
    many(spark, [(1234.0, "1.2K"), (999.0, "999"), (2_000_000.0, "2M")], prices.compact_number, "double")
    got = values(spark, [(33.0, 33.06, 0.012)], "a double, b double, s double", y=F.size(prices.axis(C("a"), C("b"), C("s"))))
    assert got[0]["y"] == 6


def test_grid_sizes(spark):
    areas = [(33.6, 33.72, 10 + 1)]
    got = values(spark, areas, "a double, b double, n int", y=F.size(prices.axis(C("a"), C("b"), F.lit(0.012))), n=C("n"))
    assert got[0]["y"] == got[0]["n"]


def test_urls(spark):
    many(
        spark,
        [("http://www.Example.com//specials/", "https://example.com/specials"), ("https://example.com/specials", "https://example.com/specials"), ("https://x.com:8080/a?b=1#c", "https://x.com:8080/a?b=1"), ("ftp://x.com", ""), (None, "")],
        urls.published_url,
    )
    many(spark, [("https://www.A.com/x", "a.com"), ("http://u:p@b.org:80/", "b.org"), ("nope", "")], urls.host)
    many(spark, [("https://m.facebook.com/x", True), ("https://notfacebook.com", False)], urls.is_blocked)
    many(spark, [("https://example.com", True), ("http://localhost/x", False), ("file:///etc", False), ("http://10.0.0.1/", False), ("http://a.local", False)], urls.is_safe)
    many(spark, [("#FFF", None), ("#123", "#112233"), ("rgb(1, 2, 300)", "#0102ff"), ("red", None), ("#fded00", "#fded00"), ("#f0f0f0", None)], urls.brand_color)


def test_types_by_first_bytes(spark):
    rows = [(bytearray(b"%PDF-1.4"), ""), (bytearray(b"\x89PNG\r\n\x1a\nxx"), "text/html"), (bytearray(b"RIFF0000WEBPxx"), ""), (bytearray(b"abc"), "image/gif; q=1"), (bytearray(b""), "")]
    got = values(spark, rows, "b binary, t string", y=urls.sniff_type(C("b"), C("t")), e=urls.image_extension(C("b"), C("t")))
    assert [r["y"] for r in got] == ["application/pdf", "image/png", "image/webp", "image/gif", ""]
    assert [r["e"] for r in got][1:3] == ["png", "webp"]


def test_opening_hours(spark):
    hours = {"monday": [{"open": "11:00", "close": "14:00"}, {"open": "17:00", "close": "21:30"}], "sunday": [{"open": "20:00", "close": "02:00"}]}
    at = lambda s: dt.datetime.fromisoformat(s)
    rows = [(hours, at("2024-01-29 12:00")), (hours, at("2024-01-29 15:00")), (hours, at("2024-01-29 01:00")), (hours, at("2024-01-30 12:00")), (None, at("2024-01-30 12:00"))]
    got = values(spark, rows, "h map<string,array<struct<open:string,close:string>>>, t timestamp", y=dates.open_status(C("h"), C("t")), q=dates.open_status(C("h"), C("t"), correct=False))
    assert [r["y"] for r in got] == ["Open until 2pm", "Closed now, opens 11am", "Open until 2am", "Closed today", "Hours unknown"]
    assert got[2]["q"] == "Closed now, opens 11am"


def test_available_now(spark):
    now = F.lit(dt.datetime(2024, 1, 30, 15, 30))  # a Tuesday
    rows = [([], "3 PM - 6 PM"), (["monday"], None), ([], "Mon 3-6 pm; Tue 9-11 am"), ([], "Mon-Thu 3 PM - 5 PM; Fri-Sat 8:30 PM - 10 PM"), ([], "sometime"), ([], "all day")]
    none = F.lit(None).cast("map<string,array<struct<open:string,close:string>>>")
    got = values(spark, rows, "d array<string>, w string", y=dates.available_now(C("d"), F.array().cast("array<int>"), C("w"), none, now))
    assert [r["y"] for r in got] == [True, False, False, True, True, True]


def test_bankers_rounding_in_quality(spark):
    empty = F.array().cast(LIST)
    got = values(spark, [(0.9,), (None,), (5.0,)], "c double", y=prices.quality_score(F.lit("Happy hour deal"), empty, F.lit(None).cast("string"), empty, F.lit(None).cast("string"), empty, C("c")))
    assert [r["y"] for r in got] == [29, 25, 30]


def test_html_functions(spark):
    page = """<html><head><link rel="icon" href="/i.png" sizes="32x32"><link rel="apple-touch-icon" href="/a.png" sizes="180x180"><meta property="og:image" content="/og.jpg">
    <meta name="theme-color" content="#123"><script>var a = "<p>no</p>"</script></head><body><img class="logo" src="/logo.svg"><img src="/happy-hour-menu.jpg" alt="Happy Hour" width="800" height="600">
    <p>One &amp; two<br>three</p><a href="/specials">Daily <b>Specials</b></a><a href="menu.pdf"></a><iframe>hidden</iframe></body></html>"""
    base = "https://example.com/x"
    rows = [(base, page)]
    got = values(spark, rows, "u string, h string", lines=html.visible_lines(C("h")), links=html.links(C("h")), icons=html.icons(C("u"), C("h")), assets=html.assets(C("u"), C("h")), colors=html.theme_colors(C("h")))[0]
    assert got["lines"] == ["One & two", "three", "Daily", "Specials"]
    assert got["links"] == [{"href": "/specials", "label": "Daily Specials"}, {"href": "menu.pdf", "label": ""}]
    assert got["icons"] == ["https://example.com/logo.svg", "https://example.com/a.png", "https://example.com/og.jpg", "https://example.com/i.png", "https://example.com/favicon.ico"]
    assert got["assets"][0]["url"] == "https://example.com/happy-hour-menu.jpg" and got["assets"][0]["score"] == 15
    assert got["colors"] == ["#123"]
    assert urls.asset_address(base, r"\/\/cdn.example.com/Happy Hour Menu.jpg") == "https://cdn.example.com/Happy%20Hour%20Menu.jpg"
    assert html.lines_of(None) == [] and html.sitemap_locations("<broken") == []


def test_safe_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(8)
    names = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)]
    for net in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "224.0.0.0/4"):
        n = ipaddress.ip_network(net)
        names += [str(x) for x in (n[0], n[-1], n[0] - 1 if int(n[0]) else n[0], n[-1] + 1 if int(n[-1]) < 2**32 - 1 else n[-1])]
    names += ["192.0.0.9", "192.0.0.10", "192.0.0.170", "h.com", "localhost", "x.local", "256.1.1.1", "010.0.0.1", "1.2.3"]
    for six in ("::1", "::", "fe80::1", "fc00::1", "2001:db8::1", "2001::1", "2001:1ff::", "2002::1", "2606:4700::1111", "2a00:1450::1", "ff02::1", "64:ff9b:1::1", "2001:4860:4860::8888"):
        names.append(f"[{six}]")

    def plain(name):
        bare = name.strip("[]")
        if bare == "localhost" or bare.endswith(".local"):
            return False
        try:
            return ipaddress.ip_address(bare).is_global
        except ValueError:
            return True

    rows = [{"u": f"https://user@{n}:8080/x"} for n in names]
    got = [r["v"] for r in values(spark, rows, "u string", v=urls.is_safe(F.col("u")))]
    # Multicast of version 6 isn't a web address, whatever its scope.
    assert [(n, g) for n, g in zip(names, got, strict=True) if g != (plain(n) and n != "[ff02::1]")] == []
    assert [r["v"] for r in values(spark, [{"u": u} for u in (None, "", "ftp://h.com", "h.com", "https://", "http://H.COM")], "u string", v=urls.is_safe(F.col("u")))] == [False, False, False, False, False, True]
