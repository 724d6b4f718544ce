"""Registered queries of single rules: column functions and small operators over rows of the given tables.

Inputs are made from a row's key and words, so that every row asks another
question. The SQL computes the answers from the key by what the rule says and
takes neither patterns nor limits from the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmill.functions import dates, prices, urls
from fernmill.functions import text as T
from fernmill.operators import discovery, queues, reports, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-30 15:30:00"


def query(sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def _s(x: Column | str) -> Column:
    """Numbers as text."""
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _pick(key: Column, *values: Column | str | None) -> Column:
    """The value at ``key`` modulo how many there are."""
    out = None
    for i, v in enumerate(values):
        value = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key % len(values) == i, value) if out is None else out.when(key % len(values) == i, value)
    return out


def _part() -> tuple[Column, Column]:
    """Key and name of a part."""
    return F.col("p_partkey"), F.col("p_name")


@query(
    """SELECT p_partkey, p_name || '|x ' || p_partkey AS deduped, p_partkey % 4 < 3 AS starts, p_name || ' a ' || p_partkey || ' b' AS whole, '$' || p_partkey % 20 || ': ' || p_name || '; soup' AS tier,
    p_name AS said, 'City ' || p_partkey AS town, CASE WHEN p_partkey % 3 <> 1 THEN 'Irvine' END AS city, p_partkey % 5 IN (0, 1, 2) AS timed, 'fernhill-' || p_partkey || '.png' AS file, 'Happy Hour' AS tag, 'JD' AS initials,
    CASE WHEN p_partkey % 2 = 0 THEN 'Uno' ELSE 'Uno - X' END AS label, 'Elm Ave' AS street FROM part"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = _part()
    lines = F.array(_cat(" ", name, " -"), F.upper(name), _cat("x  ", _s(k)), F.lit("  "), _cat(name, "!"), _cat("X ", _s(k), "."))
    price = _cat("$", _s(k % 20))
    form = _cat("### Restaurant\n", name, "\n<!-- a hint\nCity -->\n\n### CITY\nold\n### City\n City ", _s(k), " \n")
    fields = T.report_fields(form)
    return _read(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(T.dedupe_lines(lines), "|").alias("deduped"),
        T.starts_offer(_pick(k, _cat("$5 ", name), _cat("20% off ", name), _cat("BOGO ", name), name)).alias("starts"),
        T.deal_text(name, F.array(_cat("a ", _s(k))), F.array(F.lit("b"))).alias("whole"),
        T.clean_tier(_cat(price, ": ", price, " ", name, ";  ", price, " soup")).alias("tier"),
        F.try_element_at(fields, F.lit("restaurant")).alias("said"),
        F.try_element_at(fields, F.lit("city")).alias("town"),
        T.city_of_address(_pick(k, _cat(_s(k), " Main St, Irvine, CA 92602"), _cat(_s(k), " Main St, Tustin, CA"), ""), F.lit("Irvine")).alias("city"),
        dates.evidence_has_time(_pick(k, _cat(name, " 3 pm"), "all day long", "Tue 3-6", name, "3-6")).alias("timed"),
        T.safe_filename(_cat("Fernhill.", _s(k)), F.lit("png")).alias("file"),
        T.tag_label(F.lit("happy_hour")).alias("tag"),
        T.initials(_cat("joe's & dad's", _s(k))).alias("initials"),
        T.restaurant_label(_pick(k, "Uno - X", "Uno - X"), _pick(k, "X", "Y")).alias("label"),
        T.street(_cat(_s(k + 1), " Elm Ave Suite ", _s(k), ", Irvine, CA")).alias("street"),
    )


_WEEK = "['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday']"
_SHORT = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"
_TH = "CASE WHEN n BETWEEN 10 AND 20 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(
    f"""WITH d AS (SELECT p_partkey, (p_partkey % 5)::INT AS i, (p_partkey % 9 + 1)::INT AS h, (p_partkey % 31 + 1)::INT AS n FROM part)
    SELECT p_partkey, array_to_string(({_WEEK})[i + 1:i + 3], ',') AS evidence, array_to_string(({_WEEK})[i + 1:i + 2], ',') AS segment, n::VARCHAR AS months,
      ({_SHORT})[i + 1] || '-' || ({_SHORT})[i + 3] || ' ' || h || 'pm-' || h + 2 || 'pm' AS shown, ({_SHORT})[i + 1] || '-' || ({_SHORT})[i + 3] || ' ' || h || 'pm-' || h + 2 || 'pm' AS shared,
      lower(({_SHORT})[i + 1]) || '-' || lower(({_SHORT})[i + 3]) || ' ' || h || '-' || h + 2 AS best, p_partkey % 3 <> 1 AS redundant,
      strftime(TIMESTAMP '2024-01-05 12:30:00' + INTERVAL 1 HOUR * (p_partkey % 200) - INTERVAL 8 HOUR, '%b %-d, %-I:%M %p') || ' PT' AS shown_at, 'Every month on the ' || n || {_TH} AS validity,
      CASE WHEN p_partkey % 3 = 0 THEN '2024-01-02 03:04:05' WHEN p_partkey % 3 = 1 THEN '0001-01-01 00:00:00' END AS parsed, CASE WHEN p_partkey % 2 = 0 THEN DATE '2024-02-29' END AS date FROM d"""
)
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _ = _part()
    i, h = (k % 5).cast("int"), (k % 9 + 1).cast("int")
    short, long = (F.array(*map(F.lit, x)) for x in (dates.SHORT_DAYS, dates.DAYS))
    day, word = lambda n: F.lower(F.get(short, i + n)), lambda n: F.initcap(F.get(long, i + n))
    n = (k % 31 + 1).cast("int")
    th = F.when(n.between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    window = _cat(word(0), " - ", word(2), "  0", _s(h), ":00 PM to 0", _s(h + 2), ":00 P.M.")
    two = _cat(day(0), "-", day(2), " ", _s(h), "-", _s(h + 2))
    seen = _pick(k, _cat("Happy: Mon-Fri ", _s(h), "pm-", _s(h + 2), "pm for all"), "Mon only", "")
    says = _pick(k, _cat("Mon-Fri, ", _s(h), " PM - ", _s(h + 2), " PM"), _cat("Mon-Fri, ", _s(h), " PM - ", _s(h + 2), " PM"), "Check source")
    return _read(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(dates.evidence_days(_cat("Served ", day(0), " - ", day(2), " only")), ",").alias("evidence"),
        F.array_join(dates.segment_days(_cat(day(0), "-", day(1), " 3-6 pm"), correct=False), ",").alias("segment"),
        F.array_join(dates.month_days(_cat("on every ", _s(n), th, " of the month")), ",").alias("months"),
        dates.schedule_text(F.when(h + 2 < 10, window).otherwise(F.regexp_replace(window, " 0", " "))).alias("shown"),
        dates.shared_schedule(_cat(word(0), " through ", word(2), " ", _s(h), "-", _s(h + 2)), F.lit("Happy Hour")).alias("shared"),
        dates.best_schedule(F.array(_cat(day(0), " ", _s(h), "-", _s(h + 2), " at the bar"), two, F.lit("whenever"))).alias("best"),
        dates.is_redundant(says, seen).alias("redundant"),
        dates.display_date(F.to_timestamp(F.lit("2024-01-05 12:30:00")) + F.make_dt_interval(F.lit(0), (k % 200).cast("int"))).alias("shown_at"),
        dates.validity(F.array().cast(T.STRINGS), F.lit(None).cast("string"), F.array(n)).alias("validity"),
        F.date_format(dates.parse_iso(_pick(k, "2024-01-02T03:04:05Z", "never", "soon"), _pick(k, _now(), dates.earliest(), F.lit(None).cast("timestamp"))), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        dates.parse_date(_pick(k, "2024-02-29", "2024-2-9")).alias("date"),
    )


@query(
    """WITH k AS (SELECT p_partkey, (p_partkey % 40)::INT AS a FROM part)
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '$' || a || '-$' || a + 5 || '.50' WHEN 1 THEN '$' || a END AS range,
      CASE p_partkey % 12 WHEN 0 THEN a || '% off' WHEN 1 THEN '50% off' WHEN 2 THEN 'BOGO' WHEN 3 THEN '2-for-1' WHEN 4 THEN '$' || a || ' off' WHEN 5 THEN '$' || a || '-$' || a + 5 WHEN 6 THEN 'Free' WHEN 7 THEN '$' || a || '+'
        WHEN 8 THEN '$' || a || ' or less' WHEN 9 THEN '$' || a || '-$' || a + 7 WHEN 10 THEN '$' || a END AS label,
      CASE WHEN a < 10 THEN printf('%.1f', a + 0.31) ELSE printf('%.0f', a + 0.31) END || ' mi' AS distance,
      CASE WHEN a = 0 THEN '0' WHEN a % 10 = 0 THEN a // 10 || 'K' WHEN a < 10 THEN a * 100 || '' ELSE a // 10 || '.' || a % 10 || 'K' END AS compact, a >= 30 AS clear FROM k"""
)
def price_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _ = _part()
    a = (k % 40).cast("int")
    amount, n = lambda x: x.cast("decimal(18,2)"), _s(a)
    none = F.array().cast("array<decimal(18,2)>")
    worth = _pick(
        k, _cat("now ", n, " % off"), "half price", "2-4-1 tonight", "two for one", _cat("$ ", n, " off"), _cat("$", n, " to $", _s(a + 5)), "free soup", _cat("from $", n), _cat("$", n, " or less"),
        _cat("$", _s(a + 7), " plates, $", n, " bowls, was $99"), _cat("bowl $", n, " regularly $80"), "nothing",
    )
    spot = F.array(*(F.array(F.lit(0), F.lit(0), a * 3) for _ in range(5)))
    return _read(spark, sf_dir, "part").select(
        "p_partkey",
        prices.price_range(_pick(k, F.array(amount(a + 5.5), amount(a)), F.array(amount(a)), none)).alias("range"),
        prices.value_label(worth, F.array().cast(T.STRINGS), F.array().cast(T.STRINGS), worth).alias("label"),
        prices.distance_label(a + F.lit(0.31)).alias("distance"),
        prices.compact_number(a * 100).alias("compact"),
        prices.contrast(spot, F.array(F.lit(0), F.lit(0), F.lit(0))).alias("clear"),
    )


@query(
    """WITH k AS (SELECT p_partkey AS k FROM part)
    SELECT k AS p_partkey, left(sha1('p' || k || '|https://h' || k % 9 || '.com/x'), 20) AS page_key, CASE WHEN k % 2 = 0 THEN sha256('u' || k || ':h|v:' || k) ELSE '' END AS assets_hash, 'uno|x|https://h' || k || '.com/a' AS scope,
      'http://h' || k || '.com:80/' AS homepage, k % 6 IN (1, 5) AS safe, k % 4 IN (0, 1) AS blocked, 'tel:+1555' || k AS phone, 'https://www.google.com/maps/search/?api=1&query=Uno%20(' || k || ')%20Elm' AS map,
      CASE k % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/webp' ELSE '' END AS sniffed, CASE k % 4 WHEN 0 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'ico' END AS extension, k % 3 = 0 AS direct,
      CASE k % 3 WHEN 0 THEN '#aabbcc' WHEN 1 THEN '#0a0bff' END AS color FROM k"""
)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _ = _part()
    key = _s(k)
    asset = lambda url, digest: F.struct(url.alias("url"), digest.alias("content_hash"))
    files = F.array(asset(_cat("u", key), F.lit("h")), asset(F.lit("v"), key))
    scope = urls.scope(F.lit("Uno"), F.lit("X"), _cat("https://H", key, ".com/A/#top"))
    data = _pick(k, *(F.unhex(F.lit(x)) for x in ("89504E470D0A1A0A00", "255044462D312E34", "524946460000000057454250", "0000010000")))
    return _read(spark, sf_dir, "part").select(
        "p_partkey",
        urls.page_key(_cat("p", key), _cat("https://h", _s(k % 9), ".com/x")).alias("page_key"),
        urls.assets_hash(_pick(k, files, F.slice(files, 1, 0))).alias("assets_hash"),
        F.concat_ws("|", scope["restaurant"], scope["city"], scope["page"]).alias("scope"),
        urls.homepage(_cat("http://h", key, ".com:80/x/y?z#w")).alias("homepage"),
        urls.is_safe(_pick(k, _cat("http://10.0.0.", _s(k % 250)), _cat("https://h", key, ".com/"), "http://localhost/x", "https://box.local", _cat("ftp://h", key, ".com"), "http://8.8.8.8/")).alias("safe"),
        urls.is_blocked(_pick(k, _cat("https://www.facebook.com/", key), _cat("https://m.yelp.com/", key), _cat("https://notyelp.com/", key), _cat("https://h.com/yelp.com/", key))).alias("blocked"),
        urls.phone_url(_cat("+1 (555) ", key)).alias("phone"),
        urls.map_url(_cat("Uno (", key, ")"), F.lit("Elm"), F.lit("")).alias("map"),
        urls.sniff_type(data, F.lit("text/html")).alias("sniffed"),
        urls.image_extension(data, F.lit("text/html")).alias("extension"),
        urls.is_direct_visual(_pick(k, _cat("https://h.com/", key, ".JPG?x"), _cat("https://h.com/", key), _cat("https://h.com/pdf/", key))).alias("direct"),
        urls.brand_color(_pick(k, "#ABC", "rgb(10, 11, 300)", "#ffffff")).alias("color"),
    )


@query(
    """SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderstatus IN ('O', 'F') AND (o_custkey % 2 = 0 OR o_custkey % 4 = 1) AS text, o_orderkey % 5 <> 0 AND o_orderstatus = 'F' AND o_custkey % 3 = 0 AS visual,
      NOT (o_orderkey % 4 = 0) AND (o_custkey % 2 = 0 OR o_orderkey % 3 = 1) AS render FROM orders"""
)
def reuse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's last text or pictures still stand, and whether a browser has to show it."""
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    status = F.when(s == "O", "ok").when(s == "F", "no_deals").otherwise("pending")
    issue, old = F.when(c % 2 == 1, c), F.when(c % 4 == 1, c).otherwise(c + 1)
    long = F.repeat(F.lit("many words of a menu "), 20)
    context = F.when(c % 2 == 0, _cat("$5 ", _s(c))).when(k % 3 == 1, long).otherwise(_cat(long, "$5"))
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey",
        queues.reusable_text(_s(k), F.when(k % 3 != 0, _s(k)).otherwise(F.lit("new")), status, issue, old).alias("text"),
        queues.reusable_visual(_s(k), F.when(k % 5 != 0, _s(k)).otherwise(F.lit("")), status, F.when(c % 3 == 0, 5).otherwise(4)).alias("visual"),
        queues.needs_render(_pick(k, "https://h.com/menu.PDF?x=1", "https://h.com/", "https://h.com/", "https://h.com/pdf"), context).alias("render"),
    )


@query(
    """WITH a AS (SELECT n_nationkey AS k, n_name AS city, n_nationkey % 3 = 0 AS known, n_nationkey % 2 = 0 AS saved FROM nation),
    s AS (SELECT k, city, CASE WHEN saved THEN CASE WHEN k % 4 = 0 THEN 'active' ELSE 'queued' END WHEN known THEN 'active' ELSE 'queued' END AS status,
        CASE WHEN saved THEN CASE WHEN k % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * k END WHEN known THEN TIMESTAMP '2024-01-20 00:00:00' END AS since FROM a)
    SELECT city, status, strftime(since, '%Y-%m-%d') AS activated, coalesce(status = 'queued' AND row_number() OVER (PARTITION BY status ORDER BY k) <= 2 AND DATE '2024-02-02' >= (SELECT max(since)::DATE + 7 FROM s WHERE status = 'active'), FALSE) AS due FROM s"""
)
def area_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of areas, saved or new, and the two that are due for activation."""
    n, k = _read(spark, sf_dir, "nation"), F.col("n_nationkey")
    areas = n.select(F.col("n_name").alias("city"), k.alias("ord"))
    stamp = F.date_format(F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    saved = n.where(k % 2 == 0).select(F.col("n_name").alias("city"), F.when(k % 4 == 0, "active").otherwise("queued").alias("status"), F.when(k % 4 == 0, stamp).alias("activated_at"), F.when(k % 4 == 0, stamp).alias("last_refreshed"))
    states = state.area_states(areas, saved, n.where(k % 3 == 0).select(F.col("n_name").alias("city")), F.lit("2024-01-20T00:00:00Z"))
    due = state.due_areas(states, F.to_timestamp(F.lit("2024-02-02 00:00:00")), most=2).select("city", F.lit(True).alias("due"))
    day = F.date_format(F.col("activated_at").cast("timestamp"), "yyyy-MM-dd")
    return states.join(due, "city", "left").select("city", "status", day.alias("activated"), F.coalesce("due", F.lit(False)).alias("due"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, 'https://s' || s_suppkey || '.example/' AS url FROM supplier)
    SELECT url, CASE WHEN k % 4 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'curated' WHEN k % 3 = 1 THEN 'ai_extracted' ELSE 'crawled' END AS mode, k % 4 > 0 AS ok, CASE WHEN k % 4 = 0 OR k % 5 = 0 THEN 0 ELSE k END AS candidate_count,
      CASE WHEN k % 4 = 0 THEN 'down ' || k END AS error, k % 4 = 0 AND k % 8 <> 0 AS alarming FROM s"""
)
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source fared, and the failures of those that aren't retired."""
    k = F.col("s_suppkey")
    url = _cat("https://s", _s(k), ".example/").alias("url")
    s = _read(spark, sf_dir, "supplier")
    sources = s.select(F.col("s_name").alias("name"), F.lit("X").alias("city"), url, _pick(k, "curated", "extracted", "discovered").alias("origin"))
    counts = s.where(k % 5 > 0).select(url, F.when(k % 4 == 0, F.lit(0)).otherwise(k).alias("n"), F.when(k % 4 == 0, _cat("down ", _s(k))).alias("error"))
    counts = counts.unionByName(s.where((k % 5 == 0) & (k % 4 == 0)).select(url, F.lit(0).cast(counts.schema["n"].dataType).alias("n"), _cat("down ", _s(k)).alias("error")))
    status = reports.source_status(sources, counts, _now())
    alarming = reports.failed(status, s.where(k % 8 == 0).select(url)).select("url", F.lit(True).alias("alarming"))
    return status.join(alarming, "url", "left").select("url", "mode", "ok", F.col("candidate_count").cast("long").alias("candidate_count"), "error", F.coalesce("alarming", F.lit(False)).alias("alarming"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each supplier, with two pages."""
    k = F.col("s_suppkey")
    page = lambda name, confidence, publish: F.struct(_cat("https://s", _s(k), ".example/", name).alias("url"), F.lit(confidence).alias("confidence"), publish.alias("publish"))
    return _read(spark, sf_dir, "supplier").select(
        k.alias("ord"), _s(k).alias("place_id"), F.col("s_name").alias("name"), F.lit("X").alias("city"), F.when(k % 5 == 0, "CLOSED_PERMANENTLY").otherwise("OPERATIONAL").alias("business_status"),
        F.when(k % 7 == 0, "https://www.facebook.com/x").when(k % 7 == 1, "").otherwise(_cat("https://s", _s(k), ".example/")).alias("website_url"),
        F.when(k % 3 > 0, F.date_format(F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((k % 50).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("specials_checked_at"),
        F.array(page("deals", "high", k % 2 == 0), page("specials", "medium", F.lit(True)), page("", "high", k % 3 == 0)).alias("specials_pages"),
    )


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_name AS name, 'https://s' || s_suppkey || '.example/' AS base FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT name, base || 'deals' AS url, k * 1000 AS ord FROM s WHERE k % 2 = 0 UNION ALL SELECT name, base, k * 1000 + 2 FROM s WHERE k % 3 = 0"""
)
def publishable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.publishable_pages(_inventory(spark, sf_dir)).select("name", "url", F.col("ord").cast("long").alias("ord"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_name AS name, 'https://s' || s_suppkey || '.example/' AS base FROM supplier),
    p AS (SELECT k, name, unnest(['deals', 'specials', '']) AS page, unnest(['high', 'medium', 'high']) AS confidence, base FROM s WHERE k % 5 <> 0)
    SELECT left(sha1(k || '|' || base || page), 20) AS key, name, CASE WHEN k % 4 = 1 AND page = 'deals' THEN 'reported' ELSE confidence END AS confidence, CASE WHEN k % 4 = 1 AND page = 'deals' THEN k END AS issue FROM p
    UNION ALL SELECT left(sha1(k || '|' || base || 'deals'), 20), name, 'reported', k FROM s WHERE k % 5 = 0 AND k % 4 = 1"""
)
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to extract from: a report takes the place of the same page of the inventory."""
    places, k = _inventory(spark, sf_dir), F.col("ord")
    reported = places.where(k % 4 == 1).select("place_id", "name", F.concat(F.lit("https://s"), "place_id", F.lit(".example/deals")).alias("url"), k.alias("issue"))
    reported = reported.unionByName(reported.withColumn("issue", F.col("issue") + 1_000_000))
    return reports.candidate_pages(reported, places).select("key", "name", "confidence", "issue")


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN DATE '2024-01-01' + (s_suppkey % 50)::INT END AS checked FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 > 1),
    line AS (SELECT k FROM s ORDER BY checked NULLS FIRST, lower(name), k::VARCHAR LIMIT 12)
    SELECT s_suppkey::VARCHAR AS place_id, line.k IS NOT NULL AND s_suppkey % 2 = 0 AS found, CASE WHEN line.k IS NOT NULL AND s_suppkey % 2 = 0 THEN '2024-01-30T15:30:00Z' WHEN s_suppkey % 3 > 0 THEN strftime(DATE '2024-01-01' + (s_suppkey % 50)::INT, '%Y-%m-%dT00:00:00Z') END AS checked
    FROM supplier LEFT JOIN line ON line.k = s_suppkey"""
)
def refreshed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose pages are looked for again, the longest unchecked first; a search that fails leaves a place its turn."""
    places = _inventory(spark, sf_dir)
    due = reports.source_refresh(places)
    found = due.select("place_id", F.slice("specials_pages", 1, 0).alias("pages"), (F.col("ord") % 2 == 0).alias("ok"))
    after = reports.with_found_pages(places, found, _now())
    return after.select("place_id", (F.size("specials_pages") == 0).alias("found"), F.col("specials_checked_at").alias("checked"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_name AS name FROM supplier)
    SELECT k, CASE WHEN k % 3 = 0 THEN 'p' || k WHEN k % 3 = 1 AND k % 4 <> 0 THEN 'p' || k END AS place_id, CASE WHEN k % 6 = 0 THEN 'b.example' WHEN k % 6 IN (1, 2) THEN 's' || k || '.example' END AS logo FROM s"""
)
def matched_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources joined to the inventory by name and city, else by host; and the first of a place's addresses with a logo."""
    k, s = F.col("s_suppkey"), _read(spark, sf_dir, "supplier")
    home = _cat("https://www.s", _s(k), ".example/home")
    inventory = s.select(_cat("p", _s(k)).alias("place_id"), k.alias("ord"), F.when(k % 3 == 0, F.upper("s_name")).otherwise(_cat("other ", _s(k))).alias("name"), F.lit("X").alias("city"), F.when(k % 3 == 1, home).otherwise("").alias("website_url"))
    curated = s.select("s_suppkey", F.col("s_name").alias("name"), F.lit("x").alias("city"), F.when(k % 4 == 0, "https://else.example/").otherwise(_cat("http://s", _s(k), ".example/deals")).alias("url"))
    matched = discovery.match_inventory(curated, inventory).select("s_suppkey", "place_id")
    addresses = s.select(k.alias("key"), F.array(_cat("https://a", _s(k), ".example"), F.when(k % 6 == 0, "https://www.b.example/x").otherwise(_cat("https://s", _s(k), ".example/y")), F.lit("https://b.example")).alias("urls")).where("key % 6 < 3")
    logos = s.where(k % 6 < 3).select(_cat("s", _s(k), ".example").alias("host")).unionByName(spark.range(1).select(F.lit("b.example").alias("host")))
    logo = discovery.best_logo_host(addresses, logos).select(F.col("key").alias("s_suppkey"), F.col("host").alias("logo"))
    return matched.join(logo, "s_suppkey", "left").select(F.col("s_suppkey").alias("k"), "place_id", "logo")


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS place, CASE o_orderstatus WHEN 'F' THEN 'reported' WHEN 'O' THEN 'high' ELSE 'medium' END AS confidence, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS sure FROM orders WHERE o_orderkey % 3 > 0),
    d AS (SELECT k, place, sure, confidence, 0 AS pos, 'proof ' || k % 4 AS said FROM o UNION ALL SELECT k, place, sure, confidence, 1, 'sum ' || k % 2 FROM o)
    SELECT place::VARCHAR AS place_id, said, arg_min('https://o' || k || '.example', sure * 1000000000 + 0 + row_number) AS url FROM (SELECT *, row_number() OVER (ORDER BY sure, 'https://o' || k || '.example', pos) AS row_number FROM d) GROUP BY place, said"""
)
def unique_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers that several pages of a place show, each once, from the surest page."""
    k = F.col("o_orderkey")
    deal = lambda summary, proof: F.struct(summary.alias("summary"), proof.alias("source_evidence"))
    proof = _cat("Proof  ", _s(k % 4), "!")
    deals = F.array(deal(_cat("any ", _s(k)), F.array(proof)), deal(_cat("Sum ", _s(k % 2)), F.array().cast(T.STRINGS)))
    s = F.col("o_orderstatus")
    pages = _read(spark, sf_dir, "orders").select(
        _s("o_custkey").alias("place_id"), F.lit("n").alias("name"), _cat("https://o", _s(k), ".example").alias("url"), F.when(s == "F", "reported").when(s == "O", "high").otherwise("medium").alias("confidence"),
        F.when(k % 3 > 0, "ok").otherwise("no_deals").alias("status"), deals.alias("deals"),
    )
    said = F.when(F.size("deal.source_evidence") > 0, F.regexp_replace(F.lower(F.regexp_replace(F.get("deal.source_evidence", F.lit(0)), " +", " ")), "!", "")).otherwise(F.lower("deal.summary"))
    return reports.unique_extracted(pages).select("place_id", said.alias("said"), "url")


@query(
    """SELECT count(*) AS pages, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS ok, count(*) FILTER (WHERE o_orderkey % 5 = 1) AS no_deals, count(*) FILTER (WHERE o_orderkey % 5 = 2) AS fetch_failed, count(*) FILTER (WHERE o_orderkey % 5 = 3) AS extract_failed,
      count(*) FILTER (WHERE o_orderkey % 5 = 4) AS pending, count(*) FILTER (WHERE o_custkey % 3 = 0) AS static_pages, count(*) FILTER (WHERE o_custkey % 3 = 1) AS rendered_pages, count(*) FILTER (WHERE o_custkey % 3 = 2) AS visual_pages,
      sum(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 3 ELSE 0 END)::BIGINT AS deals, sum(o_custkey % 2)::BIGINT AS rejected, count(*) FILTER (WHERE o_orderstatus = 'P') AS reported_pages FROM orders"""
)
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    pages = _read(spark, sf_dir, "orders").select(
        _pick(k, "ok", "no_deals", "fetch_failed", "extract_failed", "pending").alias("status"), _pick(c, "static", "rendered", "visual").alias("fetch_mode"), of(c % 3).alias("deals"), of(c % 2).alias("rejected"),
        F.when(F.col("o_orderstatus") == "P", k).alias("issue"),
    )
    return reports.extraction_summary(pages)


@query(
    """WITH c AS (SELECT c_custkey AS k FROM customer)
    SELECT 'p' || k AS place_id, 'Place ' || k AS name, 'Irvine' AS city, 'https://c' || k || '.example' AS website, 'bar,cafe' AS types, CASE WHEN k % 4 = 0 THEN 'BUSINESS_STATUS_UNSPECIFIED' ELSE 'OPERATIONAL' END AS business_status,
      (30 + k % 10)::DOUBLE AS latitude, CASE WHEN k % 2 = 0 THEN '09:00-17:30' END AS monday FROM c WHERE k % 5 > 1"""
)
def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows from places' JSON; those without id, name or the expected city go."""
    k = F.col("c_custkey")
    hours = F.struct(F.array(F.struct(F.struct(F.lit(1).alias("day"), F.lit(9).alias("hour"), F.lit(0).alias("minute")).alias("open"), F.struct(F.lit(1).alias("day"), F.lit(17).alias("hour"), F.lit(30).alias("minute")).alias("close"))).alias("periods"))
    place = F.struct(
        F.when(k % 5 != 0, _cat("p", _s(k))).alias("id"), F.struct(_cat("Place ", _s(k)).alias("text")).alias("displayName"), F.when(k % 5 == 1, "1 Elm St, Tustin, CA").otherwise("1 Elm St, irvine , CA 9").alias("formattedAddress"),
        F.struct((F.lit(30.0) + k % 10).alias("latitude"), F.lit(1.0).alias("longitude")).alias("location"), _cat("https://c", _s(k), ".example").alias("websiteUri"), F.array(F.lit("bar"), F.lit("cafe")).alias("types"),
        F.when(k % 4 > 0, "OPERATIONAL").alias("businessStatus"), F.when(k % 2 == 0, hours).alias("regularOpeningHours"),
    )
    found = discovery.places(_read(spark, sf_dir, "customer").select(F.to_json(place).alias("json"), F.lit("Irvine").alias("city")))
    monday = F.get(F.col("hours")["monday"], F.lit(0))
    return found.select("place_id", "name", "city", F.col("website_url").alias("website"), F.array_join("types", ",").alias("types"), "business_status", "latitude", F.concat_ws("-", monday["open"], monday["close"]).alias("m")).withColumn("monday", F.when(F.col("m") != "", F.col("m"))).drop("m")


@query(
    """WITH k AS (SELECT p_partkey AS k FROM part)
    SELECT k AS p_partkey, CASE k % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END AS confidence, CASE k % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE TRUE END AS thin FROM k"""
)
def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a link leads to specials, and whether a homepage shows too little without a browser."""
    k, _ = _part()
    label = _pick(k, _cat("Happy Hour ", _s(k)), _cat("see ", _s(k)), _cat("Specials ", _s(k)), "Special menu", "About", "Gift specials")
    path = _pick(k, "/x", "/lunch_specials", "/x", "/x", "/about", "/x")
    links = lambda n: F.array_repeat(F.lit("l"), n)
    return _read(spark, sf_dir, "part").select(
        "p_partkey",
        discovery.link_confidence(label, path).alias("confidence"),
        discovery.is_thin(_pick(k, links(3), links(4), links(9)), _pick(k, F.repeat(F.lit("x"), 300), F.repeat(F.lit("x"), 300), F.repeat(F.lit("x"), 199))).alias("thin"),
    )
