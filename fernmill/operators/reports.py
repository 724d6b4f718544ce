"""Summaries, status rows, scope and freshness of feeds and extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernmill.functions import dates, fixed, prices, urls
from fernmill.functions import text as T
from fernmill.operators import dedupe, queues

LOCATION = ["address", "phone", "latitude", "longitude", "hours", "google_maps_url", "business_status", "place_id"]


def source_status(sources: DataFrame, counts: DataFrame, now: Column, by: str = "url") -> DataFrame:
    """(name, city, url, mode, ok, candidate_count, checked_at, error) of each source after a run.

    ``counts`` has a row (url, n, error) for each source that was tried.
    """
    rows = sources.join(counts.select(by, "n", "error"), by, "left")
    ok = F.col("error").isNull()
    mode = F.when(~ok, "failed").when(F.col("origin") == "curated", "curated").when(F.col("origin") == "extracted", "ai_extracted").otherwise("crawled")
    return rows.select("name", "city", by, mode.alias("mode"), ok.alias("ok"), F.coalesce("n", F.lit(0)).alias("candidate_count"), dates.iso(now).alias("checked_at"), "error")


def failed(statuses: DataFrame, retired: DataFrame) -> DataFrame:
    """Sources that failed and aren't retired."""
    return statuses.where("NOT ok").join(retired.select("url").distinct(), "url", "left_anti")


def location(inventory: Column | str, fallback: Column | None = None) -> Column:
    """A place's location: the inventory's values, the fallback's where they are missing or empty."""
    base = F.col(inventory) if isinstance(inventory, str) else inventory
    text = {"latitude": False, "longitude": False, "hours": False}
    value = lambda s, c: s[c] if c in text else T.some_text(s[c])
    return F.struct(*(F.coalesce(value(base, c), *([value(fallback, c)] if fallback is not None else [])).alias(c) for c in LOCATION))


def with_source_location(offers: DataFrame, sources: DataFrame) -> DataFrame:
    """Offers with the location of their source where they have none; of sources at one address the last counts."""
    known = sources.groupBy(F.col("url").alias("_url")).agg(F.max_by("location", "ord").alias("_location"))
    return offers.join(known, F.col("source_url") == F.col("_url"), "left").withColumn("location", F.coalesce("location", "_location")).drop("_url", "_location")


def publishable_pages(inventory: DataFrame) -> DataFrame:
    """(name, city, url, ord) of the sure specials pages of places in business."""
    rows = inventory.where("business_status = 'OPERATIONAL'").select("name", "city", F.col("ord").alias("place"), F.posexplode("specials_pages").alias("pos", "page"))
    rows = rows.where("page.publish AND page.confidence = 'high' AND page.url <> ''")
    return rows.select("name", "city", "page.url", (F.col("place") * 1000 + F.col("pos")).alias("ord"))


def candidate_pages(reported: DataFrame, inventory: DataFrame) -> DataFrame:
    """(key, place_id, name, url, confidence, issue) to extract from: reported pages first, then the inventory's, each once."""
    found = inventory.where("business_status = 'OPERATIONAL'").select("place_id", "name", F.explode("specials_pages").alias("page"))
    found = found.select("place_id", "name", "page.url", "page.confidence", F.lit(None).cast("long").alias("issue"), F.lit(1).alias("prio"))
    asked = reported.select("place_id", "name", "url", F.lit("reported").alias("confidence"), F.col("issue").cast("long").alias("issue"), F.lit(0).alias("prio"))
    rows = asked.unionByName(found).withColumn("key", urls.page_key(F.col("place_id"), F.col("url")))
    return dedupe.first_of(rows, [F.col("key")], ["prio", "issue"]).drop("prio")


def unique_extracted(pages: DataFrame) -> DataFrame:
    """Offers of extracted pages, each once for a place; pages count in the order of their sureness, name and address.

    ``pages`` has place_id, name, url, confidence, status and deals (summary, source_evidence).
    """
    rows = pages.where("status = 'ok'").select("place_id", "name", "url", "confidence", F.posexplode("deals").alias("pos", "deal"))
    key = dedupe.identity(F.col("place_id"), F.col("deal.source_evidence"), F.col("deal.summary"))
    return dedupe.first_of(rows, [key], [*queues.page_order(F.col("confidence"), F.col("name"), F.col("url")), "pos"])


def extraction_summary(pages: DataFrame) -> DataFrame:
    """One row of counts over extraction results."""
    status, mode = F.col("status"), F.col("fetch_mode")
    return pages.agg(
        F.count("*").alias("pages"),
        *(F.count_if(status == s).alias(s) for s in ("ok", "no_deals", "fetch_failed", "extract_failed", "pending")),
        *(F.count_if(mode == m).alias(f"{m}_pages") for m in ("static", "rendered", "visual")),
        F.coalesce(F.sum(F.when(status == "ok", F.size("deals"))), F.lit(0)).alias("deals"),
        F.coalesce(F.sum(F.size("rejected")), F.lit(0)).alias("rejected"),
        F.count_if(F.col("issue").isNotNull()).alias("reported_pages"),
    )


def coverage(inventory: DataFrame) -> DataFrame:
    """Counts of an inventory: places, in business, with a site, with specials pages, checked."""
    return inventory.agg(
        F.count("*").alias("restaurants"),
        F.count_if(F.col("business_status") == "OPERATIONAL").alias("operational"),
        F.count_if(T.text_or_empty(F.col("website_url")) != "").alias("with_website"),
        F.count_if(F.size("specials_pages") > 0).alias("with_specials"),
        F.coalesce(F.sum(F.size("specials_pages")), F.lit(0)).alias("specials_pages"),
        F.countDistinct("city").alias("cities"),
    )


def city_counts(inventory: DataFrame) -> DataFrame:
    """(city, restaurant_count) of an inventory."""
    return inventory.groupBy("city").agg(F.count("*").alias("restaurant_count"))


def coverage_rows(states: DataFrame, inventory: DataFrame) -> DataFrame:
    """(city, state, spots, scanned, expected): areas, live ones first, each in the order of ``ord``; ``place`` says where.

    ``states`` has city, ord, status, activated_at and last_refreshed. A live area
    shows its places, shortened, and its last scan; a queued one when it is due.
    """
    live = F.col("status") == "active"
    rows = states.join(city_counts(inventory), "city", "left").join(activation_estimates(states), "city", "left")
    place = F.row_number().over(Window.orderBy(~live, "ord"))  # as many as there are areas
    return rows.select(
        place.alias("place"),
        "city",
        F.when(live, "Live").otherwise("Queued").alias("state"),
        F.when(live, prices.compact_number(F.col("restaurant_count"))).alias("spots"),
        F.when(live, F.col("last_refreshed").cast("timestamp")).alias("scanned"),
        F.when(~live, F.col("expected_at")).alias("expected"),
    )


def feed_summary(feed: DataFrame, generated_at: Column, now: Column) -> DataFrame:
    """One row over the selected offers: places, offers, and whether the feed is late."""
    place = T.location_key(F.col("restaurant"), F.col("address") if "address" in feed.columns else F.lit(None).cast("string"), F.col("city"))
    return feed.agg(F.countDistinct(place).alias("restaurants"), F.count("*").alias("deals")).withColumn("delayed", is_delayed(generated_at, now))


def status_metrics(covered: DataFrame, run: DataFrame, logos: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(place, label, value): the fourteen figures of the status page.

    ``covered`` is the row of :func:`coverage`, ``run`` that of the extraction's
    summary, ``logos`` the cached ones; ``limits`` replaces the usual limits.
    """
    lim = {"sites": queues.SITES, "texts": queues.TEXT_PAGES, "visuals": queues.VISUAL_PAGES, "activation": 7, "rescan": 35} | (limits or {})
    one = covered.crossJoin(run).crossJoin(logos.agg(F.count("*").alias("icons")))  # one row each
    n, text = lambda c: prices.compact_number(F.col(c)), F.lit
    shown = [
        ("Restaurants found", n("restaurants")), ("Official websites", n("with_website")), ("Specials pages", n("with_specials")), ("Candidate pages", n("candidate_pages")), ("Reported sources", n("reported_pages")),
        ("Browser renders", F.concat(n("rendered_pages"), text("/"), n("render_attempts"))), ("Visual deal pages", n("visual_pages")), ("Visual checks", F.concat(n("visual_attempts"), text(" calls · "), n("visual_cache_hits"), text(" cached"))),
        ("Site icons", n("icons")), ("Sites checked", text(f"{lim['sites']}/run")), ("Text batch", text(f"{lim['texts']}/run")), ("Visual batch", text(f"{lim['visuals']}/run")),
        ("City activation", text(f"1/{lim['activation']} days")), ("City rescan", text(f"{lim['rescan']} days")),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(i + 1).alias("place"), F.lit(label).alias("label"), value.alias("value")) for i, (label, value) in enumerate(shown)))))


def scope(sources: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: the sources' cities in order, how many sources and places there are, the ageing rules."""
    row = sources.agg(F.array_sort(F.collect_set("city")).alias("cities"), F.count("*").alias("source_count"))
    places = inventory.agg(F.count("*").alias("restaurant_count"))
    return row.crossJoin(places).withColumns({"stale_after_days": F.lit(fixed.STALE_AFTER_DAYS), "drop_after_days": F.lit(fixed.DROP_AFTER_DAYS)})  # one row each


def is_delayed(generated_at: Column, now: Column, hours: int = 36) -> Column:
    """Whether a feed is older than it should be; one without a time is."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(generated_at) > hours * 3600, F.lit(True))


def activation_estimates(states: DataFrame, days: int = 7) -> DataFrame:
    """(city, expected_at) of queued areas: one activation after another from the latest."""
    latest = states.agg(F.max(F.when(F.col("status") == "active", F.col("activated_at").cast("timestamp"))).alias("latest"))
    place = F.row_number().over(Window.partitionBy("status").orderBy("ord"))  # as many as there are areas
    rows = states.withColumn("n", place).where("status = 'queued'").crossJoin(F.broadcast(latest))  # one row
    return rows.select("city", (F.col("latest") + F.make_dt_interval(F.col("n") * days)).alias("expected_at"))


def source_refresh(inventory: DataFrame, most: int = queues.SITES) -> DataFrame:
    """Places whose specials pages are to be looked for again: the longest unchecked first."""
    due = inventory.where("business_status = 'OPERATIONAL' AND website_url <> ''").where(~urls.is_blocked(F.col("website_url")))
    return queues.top(due, [F.asc_nulls_first("specials_checked_at"), F.lower("name"), "place_id"], most)


def with_found_pages(inventory: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Inventory with newly found pages; a place whose search failed keeps its pages and its turn.

    ``found`` has place_id, pages and ok for each place that was tried.
    """
    new = found.where("ok").select("place_id", F.col("pages").alias("_pages"))
    rows = inventory.join(new, "place_id", "left")
    checked = F.when(F.col("_pages").isNotNull(), dates.iso(now)).otherwise(F.col("specials_checked_at"))
    return rows.withColumns({"specials_checked_at": checked, "specials_pages": F.coalesce("_pages", "specials_pages")}).drop("_pages")


def newest_first(places: DataFrame) -> DataFrame:
    """Places with the offers in ``deals`` ordered by when they were first seen, newest first."""
    newer = lambda a, b: F.when(a["first_seen"] > b["first_seen"], -1).when(a["first_seen"] < b["first_seen"], 1).otherwise(0)
    return places.withColumn("deals", F.array_sort("deals", newer))


def brand_background(colors: Column, host: Column) -> Column:
    """The first usable theme colour of a page, else the one known for its host."""
    usable = F.filter(F.transform(colors, urls.brand_color), lambda c: c.isNotNull())
    known = F.create_map(*(F.lit(x) for pair in fixed.HOST_COLORS.items() for x in pair))
    return F.coalesce(F.get(usable, F.lit(0)), F.try_element_at(known, host))
