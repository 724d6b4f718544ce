"""Operators on small tables: duplicates, merging, state, queues, discovery, serving, sources, streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fernmill.functions import fixed
from fernmill.functions import text as T
from fernmill.operators import dedupe, discovery, queues, reports, serve, state, windows
from fernmill.operators import offers as O
from fernmill.plans import jobs
from fernmill.sources import documents, fetch

def now():
    return F.lit(dt.datetime(2024, 1, 30, 15, 30))

OFFER = "id string, ord int, restaurant string, city string, summary string, details array<string>, source_evidence array<string>, time_window string, source_url string, first_seen string"


def offer(i, summary, details=(), evidence=(), window=None, url="https://a.com", seen="2024-01-01T00:00:00Z", restaurant="A", city="X"):
    return (str(i), i, restaurant, city, summary, list(details), list(evidence), window, url, seen)


def merged(spark, *rows):
    return {r.id: r for r in dedupe.greedy_merge(spark.createDataFrame(rows, OFFER)).collect()}


def test_merge_keeps_the_richer_record(spark):
    got = merged(spark, offer(1, "Feast Special for $49"), offer(2, "Feast Special for $49", ["serves four", "with salad"], url="https://a.com/2", seen="2023-12-01T00:00:00Z"))
    assert list(got) == ["2"] and got["2"].source_urls == ["https://a.com/2", "https://a.com"] and got["2"].first_seen == "2023-12-01T00:00:00Z" and got["2"].merged_ids == ["1"]


@pytest.mark.parametrize(
    ("a", "b", "n"),
    [
        (("Happy hour", "3pm-6pm"), ("Happy hour", "9pm-11pm"), 2),
        (("Wednesday Lunch special", None), ("Wednesday Dinner special", None), 2),
        (("Lunch special $9", None), ("Dinner special $9", None), 2),
        (("$49 Family Feast bundle for four", None), ("Family Feast bundle serving four $49", None), 1),
        (("$8 tacos", None), ("$9 burgers", None), 2),
    ],
)
def test_merge_pairs(spark, a, b, n):
    assert len(merged(spark, offer(1, a[0], window=a[1]), offer(2, b[0], window=b[1]))) == n


def test_merge_depends_on_order_not_on_partitions(spark):
    rows = [offer(i, s) for i, s in enumerate(["$9 red ring", "$9 red ring blue", "$9 blue hat", "$9 ring", "$9 red hat"])]
    df = spark.createDataFrame(rows, OFFER)
    sets = [sorted((r.id, tuple(r.merged_ids)) for r in dedupe.greedy_merge(df.repartition(n)).collect()) for n in (1, 3, 7)]
    assert sets[0] == sets[1] == sets[2]


def test_duplicate_pairs_agree_with_the_row_test(spark):
    rows = [offer(i, s) for i, s in enumerate(["$9 red ring", "red ring $9", "Mon $9 red ring", "Tue $9 red ring", "BOGO hat", "bogo hat!", "ring"])]
    df = O.annotate(spark.createDataFrame(rows, OFFER).withColumns({"tags": F.array().cast("array<string>"), "applies_days": F.array().cast("array<string>")}))
    got = {(r.left, r.right) for r in dedupe.duplicate_pairs(df, "id").select("left", "right").collect()}
    marked = dedupe.marks(df).select("id", "m").collect()
    marks = {r.id: dedupe._read_marks(r.m.asDict()) for r in marked}
    assert got and got == {(a, b) for a in marks for b in marks if a < b and marks[a].agrees(marks[b])}


def _offers(seed, n, words="red ring blue hat old shoe new coat".split()):
    rng = random.Random(seed)
    lead = ["$9 ", "$9 ", "BOGO ", "", "20% off "]
    return [offer(i, rng.choice(lead) + " ".join(rng.sample(words, rng.randrange(1, 5))) + rng.choice(["", "", " Mon", " Tue"]), window=rng.choice([None, None, "3 PM - 6 PM", "9 PM - 11 PM"]), restaurant=rng.choice("AAAAB"), evidence=["x"] * rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_split_places_merge_to_the_same_rows(spark, seed):
    df = spark.createDataFrame(_offers(seed, 120), OFFER)
    rows = lambda **o: sorted(map(repr, dedupe.greedy_merge(df, **o).collect()))
    assert rows(place_rows=0) == rows(place_rows=40) == rows()
    assert len(rows()) < 100


def test_prefixes_meet_every_pair(spark):
    df = O.annotate(spark.createDataFrame(_offers(3, 150), OFFER).withColumns({"tags": F.array().cast("array<string>"), "applies_days": F.array().cast("array<string>")}))
    got = {(r.left, r.right) for r in dedupe.duplicate_pairs(df, "id").select("left", "right").collect()}
    rows = {r.id: (r.restaurant, dedupe._read_marks(r.m.asDict())) for r in dedupe.marks(df).select("id", "restaurant", "m").collect()}
    assert got == {(a, b) for a, (p, x) in rows.items() for b, (q, y) in rows.items() if a < b and p == q and x.agrees(y)} and got
    met = dedupe.candidates(dedupe.marks(df).select("id", "restaurant", "city", "m")).select("left", "right").distinct().count()
    shared = sum(a < b and p == q and bool(set(x.handles()) & set(y.handles())) for a, (p, x) in rows.items() for b, (q, y) in rows.items())
    assert len(got) <= met < shared  # fewer pairs meet than share a word


def test_names_meet_by_their_beginnings(spark):
    known = spark.createDataFrame([(1, "Joe's Pizza", "X"), (2, "Joe's", "Y"), (3, "Joe's Pizza Palace", "X"), (4, "Uno", "X"), (5, "Uno", "X")], "place_id int, name string, city string")
    asked = [(1, "joe's pizza", "x"), (2, "Joes Pizza Palace", "X"), (3, "Joe's Pizza Grill", "X"), (4, "Joe's Bar", "Y"), (5, "Uno", "X"), (6, "Joe's Pizzeria", "X"), (7, "", "X"), (8, None, "X")]
    got = discovery.match_reports(spark.createDataFrame([(*a, "s") for a in asked], "issue int, name string, city string, source string"), known)
    assert sorted((r.issue, r.place_id) for r in got.collect()) == [(1, 1), (3, 1), (4, 2)]


def test_one_queue_is_ranked_over_partitions(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(40), rng.random() < 0.1) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, k int, r boolean").repartition(7)
    ranked = {r.i: r["rank"] for r in queues.ranked(df, [F.desc("k"), F.col("i")]).collect()}
    assert [i for i, _ in sorted(ranked.items(), key=lambda x: x[1])] == [i for i, _, _ in sorted(rows, key=lambda x: (-x[1], x[0]))] and sorted(ranked.values()) == list(range(900))
    day = F.to_date(F.lit("2024-01-30"))
    whole = {r.i: r.place for r in queues.rotated(df, F.col("r"), ["k", "i"], day).collect()}
    assert whole == {r.i: r.place for r in queues.rotated(df, F.col("r"), ["k", "i"], day, parts=F.lit(1)).collect()}
    assert queues.ranked(df.limit(0), ["k"]).count() == 0 and queues.rotated(df.limit(0), F.col("r"), ["k"], day).count() == 0


def test_consolidate_tiers(spark):
    schema = "page string, ord int, summary string, details array<string>, applies_days array<string>, applies_month_days array<int>, time_window string, categories array<string>, valid_through string, source_evidence array<string>, ai_confidence double"
    when = ["MON-FRI 3-6:30 SAT + SUN 1-5"]
    rows = [
        ("p", 0, "Lunch bowl $9", [], ["monday"], [], None, ["food"], None, [], 0.9),
        ("p", 1, "$8 Social Hour Food", ["$8: $8 fries; $8 soup"], [], [], None, ["food"], None, when, 0.95),
        ("p", 2, "$10 Social Hour", ["sliders"], ["monday"], [], None, ["food"], None, [], 0.9),
        ("p", 3, "$13 Social Hour and Drinks", ["cocktails", "Dine in only"], [], [], None, ["drink"], "2030-01-01", [], 0.99),
    ]
    got = {r.ord: r for r in dedupe.consolidate(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == [0, 1]
    one = got[1]
    assert one.summary == "$8-$13 Social Hour" and one.time_window == "Mon-Fri 3pm-6:30pm; Sat-Sun 1pm-5pm" and one.applies_days == fixed.DAYS
    assert one.details == ["$8: $8: fries; soup", "$10: sliders", "$13: cocktails", "Dine in only"] and one.categories == ["food", "drink"]
    assert one.valid_through == "2030-01-01" and one.ai_confidence == 0.9 and one.grouped_deals == 3


def archive(spark, *rows):
    df = spark.createDataFrame(rows, "id string, restaurant string, city string, source_url string, summary string, status string, first_seen string, last_seen string")
    scope = [F.lower("restaurant"), F.lower("city")]
    return {r.id: r for r in state.archive_replaced(df, scope, T.signature(F.col("summary")), now()).collect()}


def feed_row(i, status, last, first="2024-01-01", summary="$8 Social Hour"):
    return (i, "A", "X", "u", summary, status, first, last)


def test_archive(spark):
    got = archive(spark, feed_row("a", "active", "2024-01-30", "2024-01-20"), feed_row("s", "stale", "2024-01-10", "2024-01-02", "$10 Social Hour Food"))
    assert got["s"].retired_reason == "replaced_by_canonical_offer" and got["s"].canonical_id == "a" and got["a"].first_seen == "2024-01-02" and got["a"].retired_at is None
    got = archive(spark, feed_row("a", "active", "1"), feed_row("b", "active", "1"), feed_row("s", "stale", "1"))
    assert all(r.retired_reason is None for r in got.values())
    got = archive(spark, feed_row("s", "stale", "1"), feed_row("t", "stale", "2"))
    assert got["t"].retired_reason is None and got["s"].retired_reason == "superseded_stale_variant" and got["s"].canonical_id == "t"
    got = archive(spark, feed_row("a", "active", "1", summary="$5"), feed_row("s", "stale", "1", summary="$6"))
    assert all(r.retired_reason is None for r in got.values())


def test_step_replays(spark):
    rows = [("1", 0, "Happy hour $8 tacos"), ("2", 1, "$8 tacos happy hour"), ("3", 2, "Gift cards 10% off"), ("4", 3, "BOGO pizza Tuesday")]
    text = F.col("summary")
    found = spark.createDataFrame(rows, "id string, ord int, summary string").withColumns(
        {
            "restaurant": F.lit("A"), "city": F.lit("X"), "source_url": F.lit("https://a.com"), "source_notes": F.lit(""), "candidate_text": text, "details": F.array().cast("array<string>"), "source_evidence": F.array().cast("array<string>"), "tags": T.detect_tags(text),
            "categories": T.categories(text), "applies_days": F.array().cast("array<string>"), "time_window": F.lit(None).cast("string"), "validity": F.lit(""), "ai_confidence": F.lit(None).cast("double"), "first_seen": F.lit("2024-01-30T00:00:00Z"), "last_seen": F.lit("2024-01-30T00:00:00Z"),
            "status": F.lit("active"), "is_stale": F.lit(False), "days_since_seen": F.lit(0),
        }
    )
    old = found.limit(0)
    history = spark.createDataFrame([], "id string, retired_at timestamp")
    first = state.run_step(found, old, history, now())
    kept = sorted(r.id for r in first.feed.collect())
    assert kept == ["1", "4"] and [r.id for r in first.rejected.collect()] == ["3"]
    again = state.run_step(found, first.feed.select(*found.columns), first.history, now())
    assert sorted(r.id for r in again.feed.collect()) == kept and again.retired.count() == 0


def test_areas(spark):
    schema = "city string, ord int, status string, activated_at string, last_refreshed string"
    seen = "2026-09-10T16:26:21Z"
    states = spark.createDataFrame([("a", 0, "active", seen, seen), ("b", 1, "queued", None, None)], schema)
    at = lambda s: F.lit(dt.datetime.fromisoformat(s))
    due = lambda s, **k: [r.city for r in state.due_areas(states, at(s), **k).collect()]
    assert due("2026-09-17 14:37") == ["b"] and due("2026-09-16 23:59") == []
    assert due("2026-09-11 00:00", force=True) == ["b"] and due("2026-09-11 00:00", migration=True) == ["b"]
    only = spark.createDataFrame([("a", 0, "active", seen, seen)], schema)
    assert [r.city for r in state.due_areas(only, at("2026-10-20 00:00")).collect()] == ["a"]
    assert state.next_due(states, at("2026-09-11 00:00")).first()[0] == dt.datetime(2026, 9, 17, 16, 26, 21)
    fresh = state.area_states(spark.createDataFrame([("a", 0), ("b", 1)], "city string, ord int"), None, spark.createDataFrame([("a",)], "city string"), F.lit(seen))
    assert {r.city: r.status for r in fresh.collect()} == {"a": "active", "b": "queued"}


def test_fair_queue_and_budget(spark):
    rows = [("Alpha", 0), ("Alpha", 1), ("Bravo", 2), ("Charlie", 3), ("Delta", 4)]
    fair = queues.fair(spark.createDataFrame(rows, "who string, ord int"), ["who"], ["ord"]).orderBy("turn", "ord")
    assert [r.who for r in fair.limit(4).collect()] == ["Alpha", "Bravo", "Charlie", "Delta"]
    items = [("x", 6), ("y", 6), ("z", 4), ("x", 1), ("w", 1)]
    df = spark.createDataFrame([([{"h": h, "bytes": b} for h, b in items],)], "a array<struct<h:string,bytes:bigint>>")
    kept = df.select(queues.fit_budget(F.col("a"), "bytes", "h", most=3, budget=11).alias("k")).first().k
    assert [r.h for r in kept] == ["x", "z", "w"]


def test_rotation_turns_with_the_day(spark):
    df = spark.createDataFrame([(i, i == 3) for i in range(5)], "i int, r boolean")
    orders = []
    for day in ("2024-01-30", "2024-01-31"):
        placed = queues.rotated(df, F.col("r"), ["i"], F.to_date(F.lit(day)), step=1).orderBy("place").collect()
        orders.append([r.i for r in placed])
        assert orders[-1][0] == 3 and sorted(orders[-1]) == list(range(5))
    assert orders[1] == [3, *orders[0][2:], orders[0][1]]


def test_logo_queue(spark):
    rows = [("kfc.com", True, False, None, None), ("a.com", False, False, "missing", "2024-01-20T00:00:00Z"), ("b.com", True, True, "ok", "2023-01-01T00:00:00Z"), ("c.com", True, False, "ok", "2024-01-01T00:00:00Z"), ("d.com", True, False, "missing", "2024-01-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "host string, active boolean, has_logo boolean, status string, checked_at string")
    assert [r.host for r in queues.logo_queue(df, now()).collect()] == ["d.com", "b.com", "kfc.com"]


def test_cache_hits(spark):
    rows = [("h", "h", "ok", None, None), ("h", "h", "ok", 7, 7), ("h", "h", "ok", 7, None), ("", "", "ok", None, None), ("h", "g", "ok", None, None), ("h", "h", "pending", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, s string, i int, p int")
    got = df.select(queues.reusable_text(*map(F.col, "absip")).alias("y")).collect()
    assert [r.y for r in got] == [True, True, False, False, False, False]


def test_gate(spark):
    assert state.passes_gate(spark.createDataFrame([(True,)] * 8 + [(False,)] * 2, "ok boolean"))
    assert not state.passes_gate(spark.createDataFrame([(False,)], "ok boolean"))


def test_judges_evidence(spark):
    schema = "summary string, details array<string>, evidence array<string>, applies_days array<string>, applies_month_days array<int>, categories array<string>, time_window string, valid_through string, confidence double, context string"
    context = "1. $6 beers every Tuesday from 3pm to 6pm\n2. Lunch or dinner for just $1.99"
    row = lambda s, e, c=0.95, d=("tuesday", "friday"), t="none": (s, [], [e], list(d), [], ["drink"], "3pm-6pm", t, c, context)
    rows = [row("$6 beers", "$6 BEERS every tuesday"), row("$6 beers", "$7 beers every Tuesday"), row("$6 beers", "$6 beers every Tuesday", 0.5), row("Lunch for just $1.99", "Lunch or dinner for just $1.99"), row("$6 beers", "$6 beers every Tuesday", t="2020-01-01"), row("Menu", "$6 beers every Tuesday")]
    got = O.judge_extracted(spark.createDataFrame(rows, schema), now()).collect()
    assert [r.accepted for r in got] == [True, False, False, True, False, False]
    assert got[0].applies_days == ["tuesday"] and got[0].time_window is None
    assert [r.accepted for r in O.judge_extracted(spark.createDataFrame(rows[:1], schema), now(), 0.96).collect()] == [False]


def test_builds_offers(spark):
    rows = spark.createDataFrame([("A", "https://a.com", "X", "weekly special", "$8 tacos", ["Tuesday 3-6 pm", "tuesday 3-6 PM"], [], "Check source")], "name string, url string, city string, notes string, summary string, details array<string>, applies_days array<string>, validity string")
    got = O.build_supplied(rows, F.lit("2024-01-30T00:00:00Z")).first()
    assert got.details == ["Tuesday 3-6 pm"] and got.applies_days == ["tuesday"] and got.time_window == "3 PM - 6 PM" and got.validity == "Check source" and got.categories == ["food"]
    assert len(got.id) == 16 and got.status == "active" and got.source_evidence == []


def test_context_and_candidates(spark):
    lines = ["Welcome to our place", "x" * 600, "Happy hour $5 beers", "Mon-Fri 3-6 pm", "Dine in only", "Copyright us", "Free dessert with purchase"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(windows.context_of(F.col("l")).alias("c")).first().c.splitlines()[:2] == ["1. Welcome to our place", "2. Happy hour $5 beers"]
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, pos int, line string")
    got = {r.summary: r for r in windows.candidates(rows, "doc").collect()}
    assert "Happy hour $5 beers" in got and "Mon-Fri 3-6 pm" in got["Happy hour $5 beers"].details and "Copyright us" not in got["Happy hour $5 beers"].details


def test_discovery(spark):
    page = '<a href="/happy-hour">Join us</a><a href="https://other.com/deals">Deals</a><a href="/specials-menu">Specials menu</a><a href="specials">Our specials</a>'
    pages = spark.createDataFrame([("https://www.a.com/", page)], "url string, html string")
    sitemap = '<urlset xmlns="x"><url><loc>https://a.com/menu</loc></url><url><loc>https://a.com/happy-hour</loc></url><url><loc>https://a.com/weekday-specials</loc></url></urlset>'
    got = {r.url: (r.confidence, r.discovered_via) for r in discovery.discover(pages, spark.createDataFrame([("https://www.a.com/", sitemap)], "url string, xml string")).collect()}
    assert got == {"https://www.a.com/happy-hour": ("high", "site_link"), "https://www.a.com/specials": ("medium", "site_link"), "https://a.com/happy-hour": ("high", "sitemap"), "https://a.com/weekday-specials": ("high", "sitemap"), "https://www.a.com/": ("medium", "page_text")}
    probes = spark.createDataFrame([("https://b.com/", "https://b.com/deals", "<p>Happy hour!</p>"), ("https://b.com/", "https://b.com/specials", "<p>no</p>")], "site string, url string, html string")
    got = discovery.discover(spark.createDataFrame([("https://b.com/", "")], "url string, html string"), probes=probes).collect()
    assert [(r.url, r.label, r.discovered_via) for r in got] == [("https://b.com/deals", "Deals", "known_path")]
    assert discovery.known_paths(pages).count() == 8


def test_places(spark):
    raw = {"id": "p", "displayName": {"text": "Uno"}, "formattedAddress": "1 A St, Irvine, CA 92618", "location": {"latitude": 33.6, "longitude": -117.8}, "regularOpeningHours": {"periods": [{"open": {"day": 0, "hour": 9}, "close": {"day": 0, "hour": 17, "minute": 30}}, {"open": {"day": 1, "hour": 9}}]}}
    other = raw | {"id": "q", "formattedAddress": "1 A St, Tustin, CA"}
    got = discovery.places(spark.createDataFrame([(json.dumps(x), "Irvine") for x in (raw, other, {"id": ""})] + [("broken", "Irvine")], "json string, city string")).collect()
    assert [r.place_id for r in got] == ["p"] and {k: [tuple(x) for x in v] for k, v in got[0].hours.items()} == {"sunday": [("09:00", "17:30")]} and got[0].business_status == "BUSINESS_STATUS_UNSPECIFIED"


def test_query_spec_travels():
    spec = serve.QuerySpec(query="taco", cities=("A", "B"), day="", types=("food",), chains=False, sort="newest", new_only=True)
    assert serve.QuerySpec.from_params("?" + spec.to_params()) == spec
    assert serve.QuerySpec.from_params("") == serve.QuerySpec() and serve.QuerySpec().to_params() == ""
    assert serve.QuerySpec.from_params("sort=bad&day=bad&type=") == serve.QuerySpec(types=())
    assert serve.QuerySpec(available_now=True, day="monday").settled().day == "today" and serve.QuerySpec(sort="alpha", radius=3).settled().radius is None
    assert spec.active_filters() == 6


def test_serving_filters(spark):
    rows = [("KFC", "A", "deal", ["food"], ["monday"], "active"), ("Uno", "A", "happy hour", ["drink"], [], "active"), ("Duo", "B", "soup", ["general"], ["tuesday"], "active"), ("Old", "B", "x", ["food"], [], "stale")]
    feed = spark.createDataFrame(rows, "restaurant string, city string, summary string, categories array<string>, applies_days array<string>, status string")
    names = lambda **k: sorted(r.restaurant for r in serve.select(feed, serve.QuerySpec(**k), now()).collect())
    assert names(day="") == ["Duo", "KFC", "Uno"] and names() == ["Duo", "Uno"] and names(day="monday") == ["KFC", "Uno"]
    assert names(day="", types=("food",)) == ["KFC"] and names(day="", types=()) == [] and names(day="", kinds=("happy_hour",)) == ["Uno"]
    assert names(day="", chains=False) == ["Duo", "Uno"] and names(day="", query="SOUP") == ["Duo"] and names(day="", cities=("B",)) == ["Duo"]
    assert names(day="", favorites_only=True, favorites=("Uno|A",)) == ["Uno"] and names(day="", radius=3) == []


def test_documents_round_trip(spark, tmp_path):
    from pyspark.sql import types as S

    element = S.StructType([S.StructField("id", S.StringType()), S.StructField("n", S.IntegerType())])
    feed = spark.createDataFrame([("b", 2), ("a", 1), (None, 3)], element).withColumn("ord", F.col("n"))
    documents.write_document(str(tmp_path / "feed"), spark.createDataFrame([(fixed.FEED_VERSION,)], "feed_version int"), deals=feed)
    assert [r.id for r in documents.snapshot(spark, str(tmp_path / "feed"), element, fixed.FEED_VERSION).orderBy("n").collect()] == ["a", "b"]
    assert documents.snapshot(spark, str(tmp_path / "feed"), element, 1).count() == 0
    assert documents.snapshot(spark, str(tmp_path / "none"), element, 1).count() == 0
    (tmp_path / "bad.json").write_text("{broken")
    assert documents.member(spark, str(tmp_path / "bad.json"), "deals", element).count() == 0
    documents.write_table(spark.createDataFrame([("x", 1), ("y", 2)], "city string, n int"), str(tmp_path / "t"), ["city"])
    documents.write_table(spark.createDataFrame([("y", 3)], "city string, n int"), str(tmp_path / "t"), ["city"])
    assert sorted((r.city, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("x", 1), ("y", 3)]
    files = documents.write_files(spark.createDataFrame([("a.bin", bytearray(b"x" * 3000)), ("b.bin", bytearray(b"small"))], "name string, content binary"), f"file://{tmp_path}/f")
    assert sorted(r.bytes for r in files.collect()) == [5, 3000]
    assert [r.bytes for r in documents.read_binaries(spark, str(tmp_path / "f")).collect()] == [3000]


def test_fetch_reports_failures(spark):
    def call(url):
        if "bad" in url:
            raise OSError("down")
        return f"<p>{url}</p>"

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "k int, url string")
    got = {r.k: r for r in fetch.fetch(rows, "k", "url", call).collect()}
    assert got[1].body == "<p>good</p>" and got[2].error == "OSError: down"
    tries, waits = [], []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError("again")
        return "ok"

    assert fetch.tried(flaky, fetch.Policy(), waits.append)("u") == "ok" and waits == [1.0, 2.0]
    with pytest.raises(fetch.Refused):
        fetch.tried(lambda x: (_ for _ in ()).throw(fetch.Refused("403")), fetch.Policy(), waits.append)("u")


def test_streams(spark, tmp_path):
    from fernmill.streaming import feed

    rows = [("1", dt.datetime(2024, 1, 1), "view", 1.0), ("1", dt.datetime(2024, 1, 1, 1), "view", 1.0), ("2", dt.datetime(2024, 1, 2), "view", 2.5)]
    schema = "id string, seen_at timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    feed.distinct_offers(stream()).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.table("firsts").collect()) == ["1", "2"]
    feed.activity(stream(), "seen_at").writeStream.format("memory").outputMode("complete").queryName("days").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("days").collect()) == [(1, 2.5), (2, 2.0)]
    feed.keep_latest(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), "id", "seen_at").awaitTermination()
    assert sorted((r.id, r.value) for r in spark.read.parquet(str(tmp_path / "out/batch=0")).collect()) == [("1", 1.0), ("2", 2.5)]


def test_a_snapshot_rewrites_only_what_a_batch_touches(spark, tmp_path):
    from fernmill.streaming import feed

    schema = "id string, t int, v string"
    want, rng = {}, random.Random(4)
    (tmp_path / "in").mkdir()
    for n in range(4):
        rows = [(str(rng.randrange(60 if n == 0 else 6)), rng.randrange(50), rng.choice("abc")) for _ in range(200 if n == 0 else 12)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for i, t, v in rows:
            want[i] = max(want.get(i, (t, v)), (t, v))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        feed.keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id", "t", parts=16).awaitTermination()
        like = spark.createDataFrame([], schema)
        got = {r.id: (r.t, r.v) for r in feed.latest(spark, str(tmp_path / "out"), like).collect()}
        assert got == want
    written = [len(list((tmp_path / "out" / f"batch={n}").glob("part=*"))) for n in range(4)]
    assert written[0] <= 16 and written[3] <= 6  # small batches touch few parts, and old folders of those are gone
    listed = json.loads((tmp_path / "out/parts-3.json").read_text())
    assert set(listed.values()) >= {0, 3} and written[0] < 16


def test_reports_and_summaries(spark):
    page = "struct<url:string,confidence:string,publish:boolean>"
    inv = spark.createDataFrame(
        [(0, "p", "Uno", "X", "OPERATIONAL", "https://uno.com", None, [("https://uno.com/deals", "high", True), ("https://uno.com/s", "medium", True)]), (1, "q", "Duo", "Y", "CLOSED", "", "2024", [("https://duo.com/deals", "high", True)])],
        f"ord int, place_id string, name string, city string, business_status string, website_url string, specials_checked_at string, specials_pages array<{page}>",
    )
    assert [r.url for r in reports.publishable_pages(inv).collect()] == ["https://uno.com/deals"]
    asked = spark.createDataFrame([("p", "Uno", "https://uno.com/deals", 7)], "place_id string, name string, url string, issue int")
    assert {(r.url, r.confidence) for r in reports.candidate_pages(asked, inv).collect()} == {("https://uno.com/deals", "reported"), ("https://uno.com/s", "medium")}
    assert reports.coverage(inv).first().asDict() == {"restaurants": 2, "operational": 1, "with_website": 1, "with_specials": 2, "specials_pages": 3, "cities": 2}
    assert [r.place_id for r in reports.source_refresh(inv).collect()] == ["p"]
    found = spark.createDataFrame([("p", [("https://n", "high", True)], True), ("q", [], False)], f"place_id string, pages array<{page}>, ok boolean")
    after = {r.place_id: r for r in reports.with_found_pages(inv, found, now()).collect()}
    assert after["p"].specials_pages[0].url == "https://n" and after["p"].specials_checked_at and after["q"].specials_pages[0].url == "https://duo.com/deals" and after["q"].specials_checked_at == "2024"
    sources = spark.createDataFrame([("Uno", "X", "u1", "curated"), ("Duo", "Y", "u2", "discovered")], "name string, city string, url string, origin string")
    tried = spark.createDataFrame([("u1", 3, None), ("u2", None, "down")], "url string, n int, error string")
    status = reports.source_status(sources, tried, now())
    assert {(r.url, r.mode, r.ok, r.candidate_count) for r in status.collect()} == {("u1", "curated", True, 3), ("u2", "failed", False, 0)}
    assert [r.url for r in reports.failed(status, sources.limit(0)).collect()] == ["u2"]
    assert reports.scope(sources, inv).first().cities == ["X", "Y"]
    got = spark.range(1).select(reports.is_delayed(F.lit(dt.datetime(2024, 1, 29)), now()).alias("a"), reports.is_delayed(F.lit(None).cast("timestamp"), now()).alias("b"), reports.brand_background(F.array(F.lit("#fff"), F.lit("#123")), F.lit("x")).alias("c"), reports.brand_background(F.array().cast("array<string>"), F.lit("beachwoodpizza.com")).alias("d")).first()
    assert tuple(got) == (True, True, "#112233", "#09a1bf")
    states = spark.createDataFrame([("a", 0, "active", "2024-01-01T00:00:00Z"), ("b", 1, "queued", None), ("c", 2, "queued", None)], "city string, ord int, status string, activated_at string")
    assert {r.city: r.expected_at for r in reports.activation_estimates(states).collect()} == {"b": dt.datetime(2024, 1, 8), "c": dt.datetime(2024, 1, 15)}
    assert fetch.robots_sitemaps("User-agent: *\nSitemap: https://a.com/s.xml\nsitemap:  https://a.com/t.xml x") == ["https://a.com/s.xml", "https://a.com/t.xml"]


def test_unique_extracted(spark):
    deal = "struct<summary:string,source_evidence:array<string>>"
    rows = [("p", "Uno", "b", "high", "ok", [("Happy hour", ["$5 Beers!"]), ("Other", [])]), ("p", "Uno", "a", "reported", "ok", [("Beers", ["$5 beers"])]), ("q", "Duo", "c", "high", "ok", [("Beers", ["$5 beers"])])]
    got = reports.unique_extracted(spark.createDataFrame(rows, f"place_id string, name string, url string, confidence string, status string, deals array<{deal}>")).collect()
    assert sorted((r.place_id, r.deal.summary) for r in got) == [("p", "Beers"), ("p", "Other"), ("q", "Beers")]


def test_jobs(spark):
    body = "<p>Happy hour $5 beers</p><p>Mon-Fri 3-6 pm</p><p>Contact us</p>"
    sources = spark.createDataFrame([("A", "X", "https://a.com", "")], "name string, city string, url string, notes string")
    made = jobs.crawl(sources, lambda url: body, F.lit("2024-01-30T00:00:00Z")).collect()
    assert "Happy hour $5 beers" in {r.summary for r in made} and all(r.restaurant == "A" for r in made)
    pages = spark.createDataFrame([("k1", "A", "https://a.com", "high"), ("k2", "B", "https://b.com", "high"), ("k3", "C", "https://c.com", "high")], "key string, name string, url string, confidence string")

    def get(url):
        if "c.com" in url:
            raise OSError("down")
        return body

    def model(prompt):
        deal = {"summary": "$5 beers", "details": [], "applies_days": ["monday"], "applies_month_days": [], "time_window": "3-6 pm", "categories": ["drink"], "valid_through": "", "evidence": ["Happy hour $5 beers", "Mon-Fri 3-6 pm"], "confidence": 0.95}
        return json.dumps({"deals": [deal, deal | {"confidence": 0.1}]})

    none = spark.createDataFrame([], "key string, content_hash string, status string, deals array<string>")
    got = {r.key: r for r in jobs.extract(pages, none, get, model, now(), most=1).collect()}
    assert {k: r.status for k, r in got.items()} == {"k1": "ok", "k2": "pending", "k3": "fetch_failed"} and [d.summary for d in got["k1"].deals] == ["$5 beers"]
    old = spark.createDataFrame([("k1", got["k1"].content_hash, "ok", ["kept"])], "key string, content_hash string, status string, deals array<string>")
    again = {r.key: r for r in jobs.extract(pages, old, get, lambda p: "broken", now()).collect()}
    assert again["k1"].cached_deals == ["kept"] and again["k2"].status == "extract_failed"
    area = spark.createDataFrame([("Irvine", 33.0, 33.01, -117.0, -117.0)], "city string, south double, north double, west double, east double")
    place = json.dumps({"id": "p", "displayName": {"text": "Uno"}, "formattedAddress": "1 A St, Irvine, CA"})
    known = spark.createDataFrame([("old", "Irvine"), ("far", "Tustin")], "place_id string, city string")
    assert sorted(r.place_id for r in jobs.scan_area(area, known, lambda cell: json.dumps([place]), 0.012, 0.014).collect()) == ["far", "p"]
    with pytest.raises(RuntimeError, match="too few"):
        jobs.scan_area(area, known, lambda cell: 1 / 0, 0.012, 0.014)


def counting(folder, answer):
    """A call that leaves a file for each time it is asked."""

    def call(asked):
        import uuid

        (folder / uuid.uuid4().hex).write_text(asked)
        return answer(asked)

    return call


def test_each_page_is_asked_once(spark, tmp_path):
    body = "<p>Happy hour $5 beers</p><p>Mon-Fri 3-6 pm</p>"
    deal = {"summary": "$5 beers", "details": [], "applies_days": ["monday"], "applies_month_days": [], "time_window": "3-6 pm", "categories": ["drink"], "valid_through": "", "evidence": ["Happy hour $5 beers", "Mon-Fri 3-6 pm"], "confidence": 0.95}
    pages = spark.createDataFrame([(f"k{i}", f"P{i}", f"https://p{i}.com", "high") for i in range(5)], "key string, name string, url string, confidence string")
    none = spark.createDataFrame([], "key string, content_hash string, status string, deals array<string>")
    (tmp_path / "pages").mkdir()
    (tmp_path / "model").mkdir()
    got = jobs.extract(pages, none, counting(tmp_path / "pages", lambda u: body), counting(tmp_path / "model", lambda p: json.dumps({"deals": [deal]})), now())
    assert got.count() == 5 and got.where("status = 'ok'").count() == 5
    assert len(list((tmp_path / "pages").iterdir())) == 5 and len(list((tmp_path / "model").iterdir())) == 5


def test_crawl_routes_and_firsts(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    deal = "struct<summary:string,details:array<string>>"
    sources = spark.createDataFrame([("A", "X", "https://a.com", "", [("$8 tacos", ["Tuesday 3-6 pm"])]), ("B", "X", "https://b.com", "", []), ("C", "X", "https://c.com", "", None)], f"name string, city string, url string, notes string, deals array<{deal}>")
    body = "<p>Happy hour $5 beers</p><p>Mon-Fri 3-6 pm</p><p>News of today and more</p><p>Happy hour $5 beers</p>"
    made = jobs.crawl(sources, counting(tmp_path / "pages", lambda u: body), F.lit("2024-01-30T00:00:00Z")).collect()
    assert sorted(x.read_text() for x in (tmp_path / "pages").iterdir()) == ["https://b.com", "https://c.com"]
    assert [r.summary for r in made if r.restaurant == "A"] == ["$8 tacos"] and len({r.id for r in made}) == len(made)
    assert any("Mon-Fri 3-6 pm" in (r.details or []) for r in made if r.restaurant == "B")


def test_the_last_cell_wins(spark):
    area = spark.createDataFrame([("Irvine", 33.0, 33.03, -117.0, -117.0)], "city string, south double, north double, west double, east double")
    known = spark.createDataFrame([], "place_id string, city string, name string")
    place = lambda cell: json.dumps([json.dumps({"id": "p", "displayName": {"text": f"N{100 - json.loads(cell)['latitude']:.2f}"}, "formattedAddress": "1 A St, Irvine, CA"})])
    got = jobs.scan_area(area, known, place, 0.012, 0.014).collect()
    names = sorted(float(100 - r["latitude"]) for r in discovery.grid(area, 0.012, 0.014).collect())
    assert [r.name for r in got] == [f"N{names[0]:.2f}"]  # the smallest name, from the northernmost cell
