"""Connectors over recorded answers: what is pushed down, asked, asked again and asked no more; sinks and the jobs over them."""

import datetime as dt
import hashlib
import json
import stat
import uuid

import pytest
from pyspark.sql import functions as F

from fernmill.functions import fixed
from fernmill.operators import discovery
from fernmill.plans import jobs
from fernmill.sources import connectors, documents, fetch, tracker
from fernmill.sources.stored import Interrupted, Ledger, Noted


def now():
    return F.lit(dt.datetime(2024, 1, 30, 15, 30))


def answer(status, body, kind="text/html"):
    return F.struct(F.lit(status).alias("status"), F.lit(kind).alias("kind"), F.lit(body).alias("body"))


def record(spark, folder, answers):
    """Recorded answers, lists of (status, body) or (status, body, kind), by (url, body)."""
    for (url, body), given in answers.items():
        row = spark.createDataFrame([(url, body)], "url string, body string")
        one = connectors.recordings(row, F.col("url"), F.col("body"), *(answer(*g) for g in given)).first()
        (folder / one.name).write_bytes(bytes(one.content))
    return f"file://{folder}"


def requests(rows, tmp_path, files=1):
    path = f"file://{tmp_path}/requests-{uuid.uuid4().hex}"
    rows.repartition(files).write.parquet(path)
    return path


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture
def web(spark, tmp_path):
    folder = tmp_path / "web"
    folder.mkdir()
    pages = {(f"https://{h}.com/{i}", ""): [(200, f"<p>{h}{i}</p>")] for h in "ab" for i in range(4)}
    pages[("https://www.c.com/x", "")] = [(500, "busy"), (200, "fine")]
    pages[("https://c.com/no", "")] = [(403, "no")]
    pages[("https://c.com/pdf", "")] = [(200, "x", "application/pdf")]
    pages[("https://c.com/latin", "")] = [(200, "café", "text/html; charset=nonsense")]
    record(spark, folder, pages)
    urls = spark.createDataFrame([(u,) for u, _ in pages] + [("https://c.com/unknown",)], "url string")
    read = connectors.register(spark).read.format("fernmill_pages").options(requests=requests(urls, tmp_path, 3), recorded=f"file://{folder}", pause="0")
    return folder, read


def test_pages(web):
    folder, read = web
    got = {r.url: r for r in read.load().collect()}
    assert got["https://a.com/1"].body == "<p>a1</p>" and got["https://www.c.com/x"].body == "fine" and got["https://c.com/latin"].body == "café"
    assert got["https://c.com/no"].error == "Refused: HTTP 403" and got["https://c.com/pdf"].error == "Refused: unsupported type application/pdf"
    assert got["https://c.com/unknown"].error == "ConnectionError: no answer is recorded" and got["https://www.c.com/x"].host == "c.com"
    assert connectors.asked(f"file://{folder}") == 8 + 2 + 1 + 1 + 1 + 2


def test_filters_are_pushed_down(spark, web):
    folder, read = web
    some = read.load().where("host = 'a.com' AND length(body) > 0").select("url")
    assert "PushedFilters: [EqualTo(host,a.com)" in plan(some)
    assert some.count() == 4 and connectors.asked(f"file://{folder}") == 4
    assert read.load().where(F.col("url").isin("https://b.com/1", "https://b.com/2")).count() == 2
    assert connectors.asked(f"file://{folder}") == 6


def test_one_partition_for_each_row_group(web):
    assert web[1].load().rdd.getNumPartitions() == 3


def test_a_policy_for_homepages_asks_once(web):
    folder, read = web
    got = {r.url: r for r in read.option("policy", "homepage").load().where("host = 'c.com'").collect()}
    assert got["https://www.c.com/x"].error == "Failed: HTTP 500: busy" and connectors.asked(f"file://{folder}") == 5


def test_a_ledger_asks_nothing_twice(web, tmp_path):
    folder, read = web
    read = read.option("ledger", f"file://{tmp_path}/ledger")
    first = sorted(map(tuple, read.load().collect()), key=repr)
    n = connectors.asked(f"file://{folder}")
    assert sorted(map(tuple, read.load().collect()), key=repr) == first and connectors.asked(f"file://{folder}") == n


def test_ledger(tmp_path):
    ledger, calls = Ledger(f"file://{tmp_path}"), []

    def good():
        calls.append(1)
        return "yes"

    assert ledger.once("k", good) == ledger.once("k", good) == "yes" and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        ledger.once("bad", lambda: 1 / 0)
    with pytest.raises(Noted, match="ZeroDivisionError"):
        ledger.once("bad", good)
    assert ledger.begin("cut") and not ledger.begin("cut")
    with pytest.raises(Interrupted):
        ledger.once("cut", good)
    assert ledger.stopped() is None
    ledger.stop("enough")
    assert Ledger(f"file://{tmp_path}").stopped() == "enough" and ledger.begun() == ["bad", "cut", "k"]


def test_waits_by_kind_of_failure():
    def run(policy, failures):
        waits, left = [], list(failures)

        def transport(_):
            f = left.pop(0) if left else connectors.Answer(200, "application/json", b"{}")
            if isinstance(f, Exception):
                raise f
            return f

        try:
            return connectors.exchange(connectors.Request("u"), transport, policy, waits.append), waits
        except Exception as e:
            return f"{type(e).__name__}", waits

    busy, down = connectors.Answer(503, "", b"later"), OSError("down")
    assert run(fetch.MODEL, [busy, busy]) == ("{}", [10, 20]) and run(fetch.MODEL, [down, down]) == ("{}", [3, 6])
    assert run(fetch.MODEL, [busy, down]) == ("{}", [10, 6]) and run(fetch.MODEL, [busy] * 3) == ("Failed", [10, 20])
    assert run(fetch.MODEL, [connectors.Answer(400, "", b"bad")]) == ("Refused", [])
    assert run(fetch.PLACES, [busy, busy]) == ("{}", [1, 2]) and run(fetch.PLACES, [connectors.Answer(404, "", b"")]) == ("Refused", [])
    assert run(fetch.PLACES, [connectors.Answer(429, "", b"slow down")])[1] == [1] and run(fetch.PLACES, [connectors.Answer(429, "", b"Requests PER DAY")]) == ("Exhausted", [])


def places(spark, tmp_path, cells, given, **options):
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    o = {"types": "bar,cafe", "radius": "500", "fields": "id,primaryType"} | options
    answers = {}
    for kinds in (["bar", "cafe"], ["bar"], ["cafe"]):
        for c, reply in zip(cells, given, strict=True):
            asked = connectors.nearby("api", "", dict(zip(("city", "latitude", "longitude"), c, strict=True)), kinds, float(o["radius"]), 20, o["fields"].split(","))
            answers[(asked.url, asked.body)] = reply
    record(spark, folder, answers)
    table = requests(spark.createDataFrame(cells, "city string, latitude double, longitude double"), tmp_path)
    read = connectors.register(spark).read.format("fernmill_places").options(requests=table, recorded=f"file://{folder}", endpoint="api", pause="0", **o)
    return folder, read


def test_places(spark, tmp_path):
    found = json.dumps({"places": [{"id": "p", "primaryType": "bar"}, {"id": "q", "primaryType": "cafe"}]})
    cells = [("X", 1.0, 2.0), ("Y", 1.5, 2.0), ("Z", 1.0, 3.0), ("W", 1.0, 4.0)]
    folder, read = places(spark, tmp_path, cells, [[(200, found, "application/json")], [(200, "{}", "application/json")], [(500, "no", "application/json")], [(200, "broken", "application/json")]])
    got = sorted((r.city, r.pos, json.loads(r.json)["id"] if r.json else None, r.error) for r in read.load().collect())
    assert got[0][:3] == ("W", -1, None) and got[0][3].startswith("ValueError") and got[1:] == [("X", 0, "p", None), ("X", 1, "q", None), ("Z", -1, None, "Failed: HTTP 500: no")]
    only = read.load().where("city = 'X' AND primary_type = 'bar'")
    assert "EqualTo(primary_type,bar)" in plan(only)
    n = connectors.asked(f"file://{folder}")
    assert [json.loads(r.json)["id"] for r in only.collect()] == ["p"] and connectors.asked(f"file://{folder}") == n + 1
    assert read.load().where("primary_type = 'pub'").count() == 0 and connectors.asked(f"file://{folder}") == n + 1
    with pytest.raises(Exception, match="unknown fields"):
        read.option("fields", "id,secret").load().collect()


def test_no_request_after_the_limit_of_the_day(spark, tmp_path):
    cells = [("X", float(i), 0.0) for i in range(9)]
    over = [(429, "quota of requests per day", "application/json")]
    given = [over if i == 3 else [(200, "{}", "application/json")] for i in range(9)]
    folder, read = places(spark, tmp_path, cells, given, ledger=f"file://{tmp_path}/ledger")
    errors = sorted((r.latitude, r.error.partition(":")[0]) for r in read.load().collect())
    stopped = len([e for _, e in errors if e == "not asked"])
    assert connectors.asked(f"file://{folder}") == 9 - stopped and ("Exhausted" in [e for _, e in errors])
    # A second run, and any other task, asks nothing more but reads what was answered.
    assert read.load().where("error LIKE 'not asked%'").count() >= stopped and connectors.asked(f"file://{folder}") == 9 - stopped


def browser(tmp_path):
    """A browser that notes when it starts and ends."""
    script = tmp_path / "browser"
    script.write_text(f"""#!/bin/sh
for last; do :; done
echo "$(date +%s%N) 1 $last" >> {tmp_path}/log
sleep 0.3
case "$last" in *slow*) echo "<b>part"; sleep 9;; *bad*) echo "<b>"; exit 3;; *) echo "<b>$last</b>";; esac
echo "$(date +%s%N) -1 $last" >> {tmp_path}/log
""")
    script.chmod(script.stat().st_mode | stat.S_IEXEC)
    return str(script)


def test_renders_have_a_budget_and_two_slots(spark, tmp_path):
    queue = [(i, f"https://p{i}.com") for i in range(30)]
    read = connectors.register(spark).read.format("fernmill_renders").options(requests=requests(spark.createDataFrame(queue, "rank int, url string"), tmp_path, 4), ledger=f"file://{tmp_path}/ledger", browser=browser(tmp_path))
    assert read.load().rdd.getNumPartitions() == 2
    got = sorted((r.rank, r.body.strip()) for r in read.load().collect())
    assert got == [(i, f"<b>https://p{i}.com</b>") for i in range(8)]
    open_, most = 0, 0
    for line in sorted((tmp_path / "log").read_text().splitlines()):
        open_ += int(line.split()[1])
        most = max(most, open_)
    assert most <= 2 and len((tmp_path / "log").read_text().splitlines()) == 16
    # Tasks that run again read what was rendered; a page that was begun and lost is not begun again.
    (tmp_path / "ledger/answers" / hashlib.sha256(b"3\nhttps://p3.com").hexdigest()).unlink()
    again = {r.rank: r for r in read.load().collect()}
    assert again[3].error.startswith("Interrupted") and again[4].body == "<b>https://p4.com</b>\n" and len((tmp_path / "log").read_text().splitlines()) == 16


def test_renders_that_fail(tmp_path):
    run = browser(tmp_path)
    assert connectors.rendered(run, "https://slow.com", 1.0) == "<b>part\n" and connectors.rendered(run, "https://bad.com", 5.0) == ""


def sitemap(*locations, kind="urlset"):
    return f"<{kind} xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<url><loc>{x}</loc></url>" for x in locations) + f"</{kind}>"


def test_sitemaps_are_walked_breadth_first(spark):
    a = "https://a.com"
    web = {
        f"{a}/robots.txt": f"User-agent: *\nSitemap: {a}/two.xml\nSITEMAP:\t{a}/two.xml\nSitemap: https://z.com/s.xml",
        f"{a}/sitemap.xml": sitemap(f"{a}/three.xml", f"{a}/deals", "https://z.com/deals", f"{a}/four.xml.gz", f"{a}/menu", kind="sitemapindex"),
        f"{a}/two.xml": sitemap(f"{a}/happy-hour", f"{a}/deals", f"{a}/sitemap.xml"),
        f"{a}/three.xml": sitemap(*(f"{a}/coupons/{i}" for i in range(20))),
        "https://b.com/sitemap.xml": "<broken",
        "https://c.com/sitemap.xml": sitemap("https://c.com/1.xml", "https://c.com/2.xml", "https://c.com/3.xml"),
        **{f"https://c.com/{i}.xml": sitemap(f"https://c.com/deals/{i}") for i in (1, 2, 3)},
    }
    asked = []

    def ask(urls):
        known = spark.createDataFrame(list(web.items()), "url string, body string")
        asked.extend(r.url for r in urls.collect())
        return urls.join(known, "url", "left")

    sites = spark.createDataFrame([(f"{a}/",), ("https://b.com/x",), ("https://c.com",), ("https://c.com",), ("nothing",)], "url string")
    got = {}
    for r in discovery.sitemap_walk(sites, ask).orderBy("site", "ord").collect():
        got.setdefault(r.site, []).append(r.url)
    # The queue of a.com is full: its robots file names two more, so nothing that sitemaps name is read.
    assert got == {f"{a}/": [f"{a}/deals", f"{a}/happy-hour"], "https://c.com": ["https://c.com/deals/1", "https://c.com/deals/2"]}
    assert sorted(asked) == sorted([f"{a}/robots.txt", f"{a}/sitemap.xml", f"{a}/two.xml", "https://b.com/robots.txt", "https://b.com/sitemap.xml", "https://c.com/robots.txt", "https://c.com/sitemap.xml", "https://c.com/1.xml", "https://c.com/2.xml"])


PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 40


def counting(folder, fn):
    folder.mkdir(exist_ok=True)

    def call(value):
        (folder / uuid.uuid4().hex).write_text(value)
        return fn(value)

    return call


def noted(folder):
    return sorted(x.read_text() for x in folder.iterdir())


def test_the_first_accepted_ends_a_key(spark, tmp_path):
    def load(url):
        if "down" in url:
            raise OSError("down")
        return (b"%s" % url.encode()) * 3, "text/plain"

    rows = [("a", 0, "down1"), ("a", 1, "no"), ("a", 2, "yes1"), ("a", 3, "yes2"), ("b", 0, "down2"), ("c", 1, "yes4"), ("c", 0, "yes3"), ("c", 2, "yes3"), ("c", 3, "yes5"), ("d", 0, "no")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(3)
    accept = lambda content, kind: kind if b"yes" in content else None
    got = fetch.accepted(df, "k", "o", "v", counting(tmp_path / "one", load), accept).collect()
    assert sorted((r.k, r.v) for r in got if r.n is not None) == [("a", "yes1"), ("c", "yes3")] and noted(tmp_path / "one") == ["down1", "down2", "no", "no", "yes1", "yes3"]
    assert sorted((r.k, r.calls, r.error) for r in got if r.n is None) == [("a", 3, "OSError: down"), ("b", 1, "OSError: down"), ("c", 1, None), ("d", 1, None)]
    got = fetch.accepted(df, "k", "o", "v", load, accept, most=2).collect()
    assert sorted((r.k, r.n, r.v) for r in got if r.n is not None) == [("a", 0, "yes1"), ("a", 1, "yes2"), ("c", 0, "yes3"), ("c", 1, "yes4")]
    assert fetch.accepted(df, "k", "o", "v", load, accept, most=3, most_bytes=20).where("n IS NOT NULL AND k = 'c'").count() == 1
    assert fetch.accepted(df.limit(0), "k", "o", "v", load, accept).count() == 0


LOGOS = "host string, path string, source_url string, background string, checked_at string, status string, error string"


def test_logos_are_cached(spark, tmp_path):
    page = lambda *icons: "<meta name='theme-color' content='#173f73'>" + "".join(f"<link rel='icon' href='{i}'>" for i in icons)
    homes = {"https://a.com/": page("/bad.png", "/good.png", "/later.png"), "https://b.com/": page("/bad.png")}

    def get(url):
        return homes[url]

    def load(url):
        if "good" in url:
            return PNG, "image/png"
        if "later" in url:
            raise AssertionError("not asked for")
        return b"<html>" * 20, "text/html"

    sites = spark.createDataFrame([("a.com", "https://a.com/"), ("b.com", "https://b.com/"), ("c.com", "https://c.com/"), ("d.com", "https://d.com/")], "host string, homepage string")
    old = [("b.com", "b-com.ico", "u", "#000000", "2023-01-01T00:00:00Z", "ok", None), ("d.com", "d-com.png", "u", None, "2024-01-29T00:00:00Z", "ok", None), ("gone.com", "gone.png", "u", None, "2024-01-29T00:00:00Z", "ok", None)]
    active = spark.createDataFrame([("a.com",)], "host string")
    got = {r.host: r for r in jobs.cache_logos(sites, active, spark.createDataFrame(old, LOGOS), now(), counting(tmp_path / "pages", get), counting(tmp_path / "icons", load), f"file://{tmp_path}/logos").collect()}
    assert sorted(got) == ["a.com", "b.com", "c.com", "d.com"] and noted(tmp_path / "pages") == ["https://a.com/", "https://b.com/", "https://c.com/"]
    a, b, c, d = (got[h] for h in sorted(got))
    assert (a.path, a.source_url, a.background, a.status, a.error) == ("a-com.png", "https://a.com/good.png", "#173f73", "ok", None) and (tmp_path / "logos/a-com.png").read_bytes() == PNG
    assert (b.path, b.status, b.checked_at, b.error) == ("b-com.ico", "missing", "2024-01-30T15:30:00Z", "no supported site icon found")
    assert (c.path, c.status) == (None, "missing") and c.error.startswith("KeyError") and (d.path, d.checked_at) == ("d-com.png", "2024-01-29T00:00:00Z")
    assert a.calls == 2 and all("later" not in u for u in noted(tmp_path / "icons"))


def test_a_feed_is_one_document(spark, tmp_path):
    deals = [{"id": f"é{i}", "n": i, "price": i / 4, "tags": ["x", str(i)], "at": {"lat": 1.5, "lon": None}, "none": None} for i in range(500)]
    schema = "ord int, id string, n int, price double, tags array<string>, at struct<lat:double,lon:double>, none string"
    rows = spark.createDataFrame([(d["n"], d["id"], d["n"], d["price"], d["tags"], (1.5, None), None) for d in deals], schema).repartition(7)
    head = {"feed_version": 4, "scope": {"cities": ["X"], "b": []}, "a": "text\n"}
    documents.write_feed(f"file://{tmp_path}/out/deals.json", head, {"deals": rows, "sources": rows.limit(0), "best": rows.where("ord < 2")})
    want = head | {"deals": deals, "sources": [], "best": deals[:2]}
    assert (tmp_path / "out/deals.json").read_text() == json.dumps(want, indent=2, sort_keys=True) + "\n"
    assert [x.name for x in (tmp_path / "out").iterdir()] == ["deals.json"]
    documents.write_feed(f"file://{tmp_path}/out/deals.json", {}, {})
    assert (tmp_path / "out/deals.json").read_text() == json.dumps({}, indent=2) + "\n"


def test_tasks_that_fail_leave_no_part(spark, tmp_path):
    spark.dataSource.register(documents.Parts)
    rows = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("fernmill_parts").option("folder", f"file://{tmp_path}/parts").mode("append").save()
    assert not (tmp_path / "parts/parts.json").exists()


def issue(state="open", about="Missing deal", labels=("report-ready", "other")):
    return {"state": state, "body": f"### What needs attention?\n\n{about}\n\n### Restaurant\n\nUno", "labels": list(labels), "comments": []}


def test_reports_are_closed_once(spark, tmp_path):
    folder = tmp_path / "issues"
    folder.mkdir()
    issues = {1: issue(), 2: issue("closed"), 3: issue(about="Wrong price"), 4: issue(labels=("source-candidate",)), 5: issue()}
    for n, i in issues.items():
        (folder / f"{n}.json").write_text(json.dumps(i))
    page = "ord int, issue int, status string, n_deals int, source_url string, restaurant string, city string"
    pages = spark.createDataFrame([(n, n, "ok", 2, f"https://p{n}.com/", f"P{n}", "X") for n in (*issues, 6)], page)
    feed = spark.createDataFrame([("active", f"https://www.p{n}.com", f"p{n} ", "x") for n in (1, 2, 3, 4, 4, 6)], "status string, source_url string, restaurant string, city string")
    plain = tracker.folder_tracker(f"file://{folder}")

    def shaky(method, path, payload=None):
        """The task dies right after its first comment."""
        if path == "/issues/1/comments" and not (tmp_path / "died").exists():
            plain(method, path, payload)
            (tmp_path / "died").write_text("")
            raise SystemExit(1)
        return plain(method, path, payload)

    ledger = f"file://{tmp_path}/ledger"
    with pytest.raises(Exception, match="(?s)."):
        jobs.close_reports(pages, feed, shaky, ledger).collect()
    got = {r.issue: r for r in jobs.close_reports(pages, feed, shaky, ledger).collect()}
    assert {n: r.outcome for n, r in got.items()} == {1: "closed", 2: "not open", 3: "about something else", 4: "closed", 6: "failed"} and "404" in got[6].error
    after = {n: json.loads((folder / f"{n}.json").read_text()) for n in issues}
    assert after[1]["state"] == after[4]["state"] == "closed" and after[1]["labels"] == ["other", "report-resolved"] and after[4]["labels"] == ["report-resolved"]
    assert after[1]["comments"] == ["Resolved automatically: 1 evidence-backed deal from https://p1.com/ are now present in the published feed for P1 (X)."]
    assert len(after[4]["comments"]) == 1 and "2 evidence-backed deals" in after[4]["comments"][0] and all(after[n] == issues[n] for n in (2, 3, 5))
    again = {r.issue: r.outcome for r in jobs.close_reports(pages, feed, plain, ledger).collect()}
    assert again[1] == "not open" and len(json.loads((folder / "1.json").read_text())["comments"]) == 1


PAGES = "key string, place string, name string, url string, confidence string, report_issue long"
DEAL = {"summary": "$5 beers", "details": [], "applies_days": ["monday"], "applies_month_days": [], "time_window": "3-6 pm", "categories": ["drink"], "valid_through": "", "evidence": ["Happy hour $5 beers", "Mon-Fri 3-6 pm"], "confidence": 0.95}
BODY = "<p>Happy hour $5 beers</p><p>Mon-Fri 3-6 pm</p>" + "".join(f"<p>Our kitchen serves happy hour plates number {i} all evening long</p>" for i in range(8))


def previous(spark, rows=()):
    return spark.createDataFrame(list(rows), "key string, " + ", ".join(f"{c} {k}" for c, k in jobs.KEPT.items()))


def run_extract(spark, tmp_path, pages, past, name, homes, pictures, **limits):
    at = lambda x: tmp_path / f"{name}-{x}"

    def get(url):
        return homes[url]

    def load(url):
        return pictures[url], "image/png"

    out = jobs.extract_all(
        spark.createDataFrame(pages, PAGES), past, counting(at("get"), get), counting(at("model"), lambda p: json.dumps({"deals": [DEAL]})), now(), counting(at("render"), lambda u: homes.get(f"rendered {u}", "")),
        counting(at("load"), load), counting(at("see"), lambda p: json.dumps({"visual_text": "Happy hour $5 beers\nMon-Fri 3-6 pm", "deals": [DEAL | {"confidence": 0.95 if "good" in p else 0.85}]})), **limits,
    )
    rows = out.collect()
    return {r.key: r for r in rows}, {x: noted(at(x)) for x in ("get", "model", "render", "load", "see") if at(x).exists()}, previous(spark, [(r.key, *(r[c] for c in jobs.KEPT)) for r in rows])


def test_extraction_takes_five_ways(spark, tmp_path):
    big = lambda tag: b"\x89PNG\r\n\x1a\n" + tag * 3_000
    thin = lambda i: f"<p>Specials</p><img src='/happy-hour-{i}.png' alt='happy hour specials'>"
    homes = {"https://t.com/": BODY, "https://u.com/": BODY.replace("$5", "$6"), "https://v.com/": thin("good"), "https://w.com/": thin("bad"), "https://r.com/": "<p>Loading</p>", "rendered https://r.com/": BODY.replace("evening", "night")}
    pictures = {"https://v.com/happy-hour-good.png": big(b"v"), "https://w.com/happy-hour-bad.png": big(b"w"), "https://x.com/good-specials.png": big(b"x")}
    pages = [("t", "1", "T", "https://t.com/", "high", None), ("u", "2", "U", "https://u.com/", "reported", 7), ("v", "3", "V", "https://v.com/", "high", None), ("w", "4", "W", "https://w.com/", "high", None), ("r", "5", "R", "https://r.com/", "high", None), ("x", "6", "X", "https://x.com/good-specials.png", "medium", None), ("z", "7", "Z", "https://z.com/", "high", None)]
    got, calls, past = run_extract(spark, tmp_path, pages, previous(spark), "one", homes, pictures)
    assert {k: r.route for k, r in got.items()} == {"t": "pending", "u": "pending", "v": "visual", "w": "visual", "r": "pending", "x": "visual", "z": "fetch_failed"}
    assert {k: r.status for k, r in got.items()} == {"t": "ok", "u": "no_deals", "v": "ok", "w": "no_deals", "r": "ok", "x": "ok", "z": "fetch_failed"}
    assert got["r"].fetch_mode == "rendered" and got["x"].fetch_mode == "visual" and got["v"].visual_status == "verified" and got["w"].visual_status == "no_deals" and got["z"].error.startswith("KeyError")
    assert [d.summary for d in got["v"].deals] == ["$5 beers"] and len(calls["see"]) == 3 and len(calls["model"]) == 3 and "https://x.com/good-specials.png" not in calls["get"]
    assert calls["render"] == sorted(f"https://{h}.com/" for h in "rvwz") and len(calls["load"]) == 3

    # Nothing has changed: pictures are loaded to know that, and nobody is asked anything.
    again, calls, _ = run_extract(spark, tmp_path, pages, past, "two", homes, pictures)
    assert "see" not in calls or calls["see"] == []
    assert calls["model"] == [] and {k: again[k].route for k in "tuvwrx"} == {"t": "cached_text", "u": "cached_text", "v": "visual", "w": "visual", "r": "cached_text", "x": "visual"}
    assert {k: (r.status, [d.summary for d in r.deals]) for k, r in again.items()} == {k: (r.status, [d.summary for d in r.deals]) for k, r in got.items()}

    # Without a look, known pictures still stand; a changed text and a new report are asked about again.
    homes["https://t.com/"] = BODY + "<p>Two for one, free dessert</p>"
    pages[1] = ("u", "2", "U", "https://u.com/", "reported", 8)
    third, calls, _ = run_extract(spark, tmp_path, pages, past, "three", homes, pictures, looks=0, texts=1)
    assert third["v"].route == third["x"].route == "cached_visual" and third["v"].deals == got["v"].deals and calls["load"] == []
    assert third["t"].route == third["u"].route == "pending" and len(calls["model"]) == 1 and third["u"].report_issue == 8
    assert third["t"].status == "ok" and third["t"].content_hash == got["t"].content_hash  # it waits, as it was


def test_looks_have_a_quota(spark, tmp_path):
    picture = lambda i: b"\x89PNG\r\n\x1a\n" + b"%d" % i * 3_000
    homes = {f"https://p{i}.com/{j}": f"<p>Specials</p><img src='/good-happy-hour-{i}-{j}.png' alt='happy hour'>" for i in range(4) for j in range(2)}
    pictures = {f"https://p{i}.com/good-happy-hour-{i}-{j}.png": picture(10 * i + j) for i in range(4) for j in range(2)}
    pages = [(f"k{i}{j}", f"place{i}", f"P{i}", f"https://p{i}.com/{j}", "high", None) for i in range(4) for j in range(2)]
    got, calls, past = run_extract(spark, tmp_path, pages, previous(spark), "one", homes, pictures, visuals=2, looks=5, renders=0)
    assert len(calls["see"]) == 2 and len(calls["load"]) == 5 and sorted(k for k, r in got.items() if r.route == "visual") == ["k00", "k10"]
    # What has been seen comes last, so every place's other page is its first now.
    got, calls, _ = run_extract(spark, tmp_path, pages, past, "two", homes, pictures, visuals=2, looks=5, renders=0)
    assert len(calls["see"]) == 2 and sorted(k for k, r in got.items() if r.route == "visual") == ["k01", "k11"]


def test_deals_that_a_look_does_not_find_stay(spark, tmp_path):
    homes = {"https://v.com/": "<p>Specials</p><img src='/happy-hour-bad.png' alt='happy hour specials'>"}
    pictures = {"https://v.com/happy-hour-bad.png": b"\x89PNG\r\n\x1a\n" + b"q" * 3_000}
    deal = ("$5 beers", [], ["monday"], [], "3-6 pm", ["drink"], None, ["Happy hour $5 beers"], 0.95)
    past = previous(spark, [("v", "h", "ok", "visual", None, "old", "verified", "2024-01-01T00:00:00Z", fixed.VISUAL_VERSION, [deal])])
    got, calls, _ = run_extract(spark, tmp_path, [("v", "3", "V", "https://v.com/", "high", None)], past, "one", homes, pictures)
    assert len(calls["see"]) == 1 and got["v"].status == "ok" and got["v"].visual_status == "no_deals" and [d.summary for d in got["v"].deals] == ["$5 beers"] and got["v"].visual_hash != "old"
