"""Registered queries over serving: availability, every filter, the order of places, and the status page.

Feeds are derived from ``part`` so that each rule meets rows on both sides of it.
The SQL writes its patterns and limits out and takes none from the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmill.functions import dates, urls
from fernmill.operators import reports, serve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: A Tuesday afternoon, and a reader's place.
NOW = "2024-01-30 15:30:00"
HERE = (33.69, -117.98)
WINDOWS = [None, "3 PM - 6 PM", "4 PM - 9 PM", "11 AM - 2 PM", "All day", "Mon-Fri 2 PM - 6 PM; Sat 1 PM - 4 PM", "Sat 2 PM - 6 PM", "while supplies last"]
DAYS = [[], ["tuesday"], ["monday", "friday"], ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"], ["tuesday", "wednesday"]]
NAMES = ["McDonald's", "Starbucks Reserve", "Uno", "Joe's Subway", "Carls Jr", "Subways & Co"]


def query(sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


def _choice(key, values):
    """The value at ``key`` modulo how many there are."""
    cases = F.lit(None)
    for i, v in enumerate(values):
        value = F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v).cast("string")
        cases = F.when(key % len(values) == i, value) if i == 0 else cases.when(key % len(values) == i, value)
    return cases


def _now():
    return F.to_timestamp(F.lit(NOW))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    clock = lambda a, b: F.create_map(F.lit("tuesday"), F.array(F.struct(F.lit(a).alias("open"), F.lit(b).alias("close"))))
    month = F.when(k % 7 == 0, F.array(F.lit(30))).when(k % 7 == 1, F.array(F.lit(5), F.lit(12))).otherwise(F.array().cast("array<int>"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("offer_id"),
        _choice(k, NAMES).alias("restaurant"),
        _choice(F.floor(k / 3), ["X", "Y", "Z"]).alias("city"),
        F.concat(F.when(k % 9 == 0, "Happy  Hour ").otherwise(""), "p_name").alias("summary"),
        _choice(F.floor(k / 2), [["food"], ["drink"], ["food", "drink"], ["general"]]).alias("categories"),
        F.when(k % 5 == 0, F.array(F.lit("happy_hour"))).otherwise(F.array(F.lit("free"))).alias("tags"),
        _choice(k, DAYS).alias("applies_days"),
        month.alias("applies_month_days"),
        _choice(k, WINDOWS).alias("time_window"),
        F.when(k % 3 == 1, clock("11:00", "22:00")).when(k % 3 == 2, clock("17:00", "22:00")).alias("hours"),
        (F.lit(33.6) + (k % 100) * F.lit(0.002)).alias("latitude"),
        (F.lit(-118.0) + (k % 70) * F.lit(0.003)).alias("longitude"),
        (_now() - F.make_dt_interval((k % 12).cast("int"))).alias("first_seen"),
        F.when(k % 11 == 0, "stale").otherwise("active").alias("status"),
        (k % 50).cast("int").alias("quality_score"),
        F.when(k % 4 == 0, "Free").alias("value_label"),
        F.concat(F.lit("https://example.com/"), k.cast("string")).alias("source_url"),
    )


_MILES = "3958.8 * 2 * asin(sqrt(pow(sin(radians(latitude - 33.69) / 2), 2) + cos(radians(33.69)) * cos(radians(latitude)) * pow(sin(radians(longitude + 117.98) / 2), 2)))"
_FEED_SQL = """feed AS (SELECT p_partkey AS k, (['McDonald''s', 'Starbucks Reserve', 'Uno', 'Joe''s Subway', 'Carls Jr', 'Subways & Co'])[(p_partkey % 6 + 1)::INT] AS restaurant,
    (['X', 'Y', 'Z'])[((p_partkey // 3) % 3 + 1)::INT] AS city, CASE WHEN p_partkey % 9 = 0 THEN 'Happy  Hour ' ELSE '' END || p_name AS summary, (p_partkey // 2) % 4 AS kind,
    33.6 + (p_partkey % 100) * 0.002::DOUBLE AS latitude, -118.0 + (p_partkey % 70) * 0.003::DOUBLE AS longitude FROM part WHERE p_partkey % 11 <> 0),
held AS (SELECT *, k % 5 <> 2 AS today, k % 7 <> 1 AS this_date, k % 3 <> 2 AS not_closed, k % 8 IN (0, 1, 4, 5, 7) AS in_window FROM feed)"""


@query(f"WITH {_FEED_SQL.replace('WHERE p_partkey % 11 <> 0', '')} SELECT k AS offer_id, today AND this_date AND not_closed AND in_window AS available, CASE k % 3 WHEN 0 THEN 'Hours unknown' WHEN 1 THEN 'Open until 10pm' ELSE 'Closed now, opens 5pm' END AS status FROM held")
def available_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each offer holds now: its days, dates and windows, and its place's hours."""
    feed = _feed(spark, sf_dir)
    return feed.select("offer_id", dates.available_now(F.col("applies_days"), F.col("applies_month_days"), F.col("time_window"), F.col("hours"), _now()).alias("available"), dates.open_status(F.col("hours"), _now()).alias("status"))


_SPECS = {
    "drinks": (serve.QuerySpec(types=("drink",), chains=False, day=""), "kind IN (1, 2) AND k % 6 IN (2, 5)"),
    "others": (serve.QuerySpec(kinds=("other",), new_only=True, day="monday"), "k % 5 <> 0 AND k % 9 <> 0 AND k % 12 <= 7 AND k % 5 IN (0, 2, 3)"),
    "hours": (serve.QuerySpec(kinds=("happy_hour",), day=""), "k % 5 = 0 OR k % 9 = 0"),
    "now": (serve.QuerySpec(available_now=True, cities=("X", "Z"), query="RING", day="friday"), "today AND this_date AND not_closed AND in_window AND city IN ('X', 'Z') AND contains(lower(summary), 'ring')"),
    "near": (serve.QuerySpec(restaurant="Uno", radius=5, location=HERE, day=""), f"restaurant = 'Uno' AND {_MILES} <= 5"),
    "own": (serve.QuerySpec(favorites_only=True, favorites=("Uno|X", "Carls Jr|Y"), day="today"), "(restaurant || '|' || city) IN ('Uno|X', 'Carls Jr|Y') AND today AND this_date"),
    "none": (serve.QuerySpec(types=(), day=""), "FALSE"),
}


@query(f"WITH {_FEED_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS spec, k AS offer_id FROM held WHERE {sql}" for name, (_, sql) in _SPECS.items()))
def serving_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of several queries selects; between them they set every filter."""
    feed, out = _feed(spark, sf_dir), None
    for name, (spec, _) in _SPECS.items():
        part = serve.select(feed, spec, _now()).select(F.lit(name).alias("spec"), "offer_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_FEED_SQL}, s AS (SELECT *, {_MILES} AS miles, (k % 50) + CASE WHEN k % 5 = 0 THEN 4 ELSE 3 END + CASE WHEN k % 5 > 0 THEN 2 ELSE 0 END + CASE WHEN k % 8 > 0 THEN 1 ELSE 0 END AS score FROM held WHERE today AND this_date),
    g AS (SELECT restaurant || '|' || city AS key, restaurant, city, count(*) AS deals, min(miles) AS distance,
      max(score) + CASE WHEN bool_or(not_closed AND in_window) THEN 55 WHEN bool_or(k % 3 = 1) THEN 16 ELSE 0 END + CASE WHEN bool_or(k % 4 = 0) THEN 10 ELSE 0 END + CASE WHEN bool_or(k % 5 IN (1, 3, 4)) THEN 8 ELSE 0 END + greatest(0.0, 24 - 3 * min(miles)) AS score
      FROM s GROUP BY restaurant, city)
    SELECT 'best' AS sort, key, deals, row_number() OVER (ORDER BY round(score, 9) DESC, lower(restaurant), key) AS rank FROM g
    UNION ALL SELECT 'distance', key, deals, row_number() OVER (ORDER BY round(distance, 9), lower(restaurant), key) FROM g
    UNION ALL SELECT 'alpha', key, deals, row_number() OVER (ORDER BY lower(restaurant), city, key) FROM g"""
)
def ordered_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of today's offers in three orders, with their rank."""
    feed, out = _feed(spark, sf_dir), None
    for sort in ("best", "distance", "alpha"):
        spec = serve.QuerySpec(sort=sort, location=HERE)
        found = serve.groups(feed, spec, _now()).withColumns({"score": F.round("score", 9), "distance": F.round("distance", 9)})
        part = serve.ranked(found, spec).select(F.lit(sort).alias("sort"), "key", "deals", "rank")
        out = part if out is None else out.unionByName(part)
    return out


_NEW_ISSUE = "https://tracker.example/new"


@query(
    f"""WITH {_FEED_SQL} SELECT DISTINCT restaurant || '|' || city AS key, '{_NEW_ISSUE}?title=%5BDeal+report%5D+' || replace(replace(replace(restaurant, '&', '%26'), '''', '%27'), ' ', '+') || '+-+' || city
    || '&body=%23%23%23+Restaurant%0A' || replace(replace(replace(restaurant, '&', '%26'), '''', '%27'), ' ', '+') || '%0A%0A%23%23%23+City%0A' || city
    || '%0A%0A%23%23%23+What+needs+attention%3F%0AMissing+or+incorrect+deal%0A%0A%23%23%23+Official+source+URL%0Ahttps%3A%2F%2Fexample.com%0A%0A%23%23%23+Details%0A%3C%21--+Describe+what+is+missing+or+incorrect%2C+including+the+right+day%2C+time%2C+price%2C+or+expiration.+--%3E' AS url
    FROM feed"""
)
def report_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link to report each place."""
    places = _feed(spark, sf_dir).where("status = 'active'").select("restaurant", "city").distinct()
    return places.select(F.concat_ws("|", "restaurant", "city").alias("key"), urls.report_url(_NEW_ISSUE, F.col("restaurant"), F.col("city"), F.lit("https://example.com")).alias("url"))


@query("SELECT n_name AS city, count(*) AS restaurant_count FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def city_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    return reports.city_counts(rows.select(F.col("n_name").alias("city")))


def _areas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k, live = F.col("n_nationkey"), F.col("n_nationkey") % 4 == 1
    day = F.date_format(F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    states = nation.select(F.col("n_name").alias("city"), k.alias("ord"), F.when(live, "active").otherwise("queued").alias("status"), F.when(live, day).alias("activated_at"), F.when(live, day).alias("last_refreshed"))
    places = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, F.col("c_nationkey") == k).select(F.col("n_name").alias("city"), F.col("c_custkey").alias("place_id"))
    return states, places


_SHORT = "CASE WHEN n >= 1000 THEN regexp_replace(printf('%.1f', n / 1000), '\\.0$', '') || 'K' ELSE n::VARCHAR END"


@query(
    f"""WITH a AS (SELECT n_nationkey AS k, n_name AS city, n_nationkey % 4 = 1 AS live, (SELECT nullif(count(*), 0) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation)
    SELECT row_number() OVER (ORDER BY NOT live, k)::INTEGER AS place, city, CASE WHEN live THEN 'Live' ELSE 'Queued' END AS state, CASE WHEN live THEN {_SHORT.replace("ELSE n::VARCHAR", "ELSE coalesce(n, 0)::VARCHAR")} END AS spots,
      CASE WHEN live THEN strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * k, '%Y-%m-%d') END AS scanned,
      CASE WHEN NOT live THEN strftime((SELECT max(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * k) FROM a WHERE live) + INTERVAL 7 DAY * row_number() OVER (PARTITION BY live ORDER BY k), '%Y-%m-%d') END AS expected FROM a"""
)
def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and queued areas with their places, last scans and expected starts."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return reports.coverage_rows(*_areas(spark, sf_dir)).select("place", "city", "state", "spots", day("scanned"), day("expected"))


@query(
    f"""WITH s AS (SELECT count(*) AS n FROM supplier), w AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0), p AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0), o AS (SELECT count(*) AS n FROM orders),
    r AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'), v AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'), l AS (SELECT count(*) AS n FROM pages)
    SELECT 1 AS place, 'Restaurants found' AS label, {_SHORT} AS value FROM s UNION ALL SELECT 2, 'Official websites', {_SHORT} FROM w UNION ALL SELECT 3, 'Specials pages', {_SHORT} FROM p
    UNION ALL SELECT 4, 'Candidate pages', {_SHORT} FROM o UNION ALL SELECT 5, 'Reported sources', {_SHORT} FROM r UNION ALL SELECT 6, 'Browser renders', '3/8' UNION ALL SELECT 7, 'Visual deal pages', {_SHORT} FROM v
    UNION ALL SELECT 8, 'Visual checks', '4 calls · ' || {_SHORT} || ' cached' FROM v UNION ALL SELECT 9, 'Site icons', {_SHORT} FROM l UNION ALL SELECT 10, 'Sites checked', '12/run' UNION ALL SELECT 11, 'Text batch', '30/run'
    UNION ALL SELECT 12, 'Visual batch', '4/run' UNION ALL SELECT 13, 'City activation', '1/7 days' UNION ALL SELECT 14, 'City rescan', '35 days'"""
)
def status_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the status page over suppliers as places, orders as pages and pages as icons."""
    page = F.struct(F.lit("u").alias("url"))
    places = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.lit("OPERATIONAL").alias("business_status"), F.when(F.col("s_suppkey") % 3 == 0, "https://x.example").otherwise("").alias("website_url"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(page, page)).otherwise(F.array().cast("array<struct<url:string>>")).alias("specials_pages"), F.lit("X").alias("city"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    run = orders.agg(F.count("*").alias("candidate_pages"), status("F").alias("reported_pages"), status("P").alias("visual_pages"), status("P").alias("visual_cache_hits"), F.lit(3).alias("rendered_pages"), F.lit(8).alias("render_attempts"), F.lit(4).alias("visual_attempts"))
    return reports.status_metrics(reports.coverage(places), run, spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(f"WITH {_FEED_SQL} SELECT count(DISTINCT restaurant || '|' || city) AS restaurants, count(*) AS deals, TRUE AS delayed FROM held WHERE today AND this_date")
def feed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of today's offers, and whether a feed of two days ago is late."""
    chosen = serve.select(_feed(spark, sf_dir), serve.QuerySpec(), _now())
    return reports.feed_summary(chosen, F.to_timestamp(F.lit("2024-01-28 15:30:00")), _now())
