"""Serving queries: filters, groups by place, scores and orders of a feed."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernmill.functions import dates, fixed, prices
from fernmill.functions import text as T
from fernmill.operators import queues

TYPES = ("food", "drink")
KINDS = ("happy_hour", "other")
VIEWS = ("list", "map")
SORTS = ("best", "alpha", "newest", "distance")
RADII = (1, 3, 5, 10)


@dataclass(frozen=True)
class QuerySpec:
    """What a reader asks for; travels as URL parameters."""

    query: str = ""
    restaurant: str = ""
    cities: tuple[str, ...] = ()
    day: str = "today"
    types: tuple[str, ...] = TYPES
    kinds: tuple[str, ...] = KINDS
    chains: bool = True
    sort: str = "best"
    radius: float | None = None
    available_now: bool = False
    new_only: bool = False
    view: str = "list"
    spot: str = ""
    favorites_only: bool = False
    favorites: tuple[str, ...] = field(default=(), compare=False)
    location: tuple[float, float] | None = field(default=None, compare=False)

    def settled(self) -> QuerySpec:
        """What choices imply: available now means today, alphabetical order has no radius."""
        out = self
        if out.available_now:
            out = _with(out, day="today")
        return _with(out, radius=None) if out.sort == "alpha" else out

    def to_params(self) -> str:
        """Only what differs from the defaults; radius, location and favourites stay with the reader."""
        base, out = QuerySpec(), {}
        for name in ("query", "restaurant"):
            if getattr(self, name):
                out["q" if name == "query" else name] = getattr(self, name)
        if self.cities:
            out["cities"] = ",".join(sorted(self.cities))
        if self.day != base.day:
            out["day"] = self.day or "any"
        for name, key in (("types", "types"), ("kinds", "offers")):
            if len(getattr(self, name)) != len(getattr(base, name)):
                out[key] = ",".join(sorted(getattr(self, name)))
        for name, key, value in (("chains", "chains", "0"), ("available_now", "now", "1"), ("new_only", "new", "1")):
            if getattr(self, name) != getattr(base, name):
                out[key] = value
        for name in ("sort", "view", "spot"):
            if getattr(self, name) != getattr(base, name):
                out[name] = getattr(self, name)
        return urlencode(out)

    @classmethod
    def from_params(cls, params: str) -> QuerySpec:
        """The asked-for query; unknown values fall back to the defaults. Older links say ``type`` and ``offer``, ``city`` and ``kind``."""
        got = {k: v[0] for k, v in parse_qs(params.lstrip("?"), keep_blank_values=True).items()}

        def listed(known: tuple[str, ...], *keys: str) -> tuple[str, ...]:
            key = next((k for k in keys if k in got), None)
            return tuple(x for x in known if x in got[key].split(",")) if key else known

        day = got.get("day")
        return cls(
            query=got.get("q", ""),
            restaurant=got.get("restaurant", ""),
            cities=tuple(sorted({x for x in got.get("cities", got.get("city", "")).split(",") if x})),
            day="" if day == "any" else day if day in fixed.DAYS else "today",
            types=listed(TYPES, "type", "types"),
            kinds=listed(KINDS, "offer", "offers", "kind"),
            chains=got.get("chains") != "0",
            sort=got.get("sort") if got.get("sort") in SORTS else "best",
            available_now=got.get("now") == "1",
            new_only=got.get("new") == "1",
            view=got.get("view") if got.get("view") in VIEWS else "list",
            spot=got.get("spot", ""),
        ).settled()

    def active_filters(self) -> int:
        base = QuerySpec()
        names = ("query", "restaurant", "cities", "day", "types", "kinds", "chains", "radius", "available_now", "new_only", "favorites_only")
        return sum(getattr(self, n) != getattr(base, n) for n in names)


def _with(spec: QuerySpec, **changes) -> QuerySpec:
    from dataclasses import replace

    return replace(spec, **changes)


#: Columns that a feed may lack, with their types.
FEED = {
    "address": "string", "latitude": "double", "longitude": "double", "hours": "map<string,array<struct<open:string,close:string>>>", "candidate_text": "string", "validity": "string", "details": T.STRINGS, "tags": T.STRINGS,
    "categories": T.STRINGS, "applies_days": T.STRINGS, "applies_month_days": "array<int>", "time_window": "string", "status": "string", "first_seen": "timestamp", "quality_score": "int", "value_label": "string", "source_url": "string",
}


def whole(feed: DataFrame) -> DataFrame:
    """``feed`` with every column that serving reads, and the text that searches look into."""
    rows = feed.withColumns({c: F.lit("active") if c == "status" else F.lit(None).cast(k) for c, k in FEED.items() if c not in feed.columns})
    rows = rows.withColumn("_words", _said())
    return rows.withColumn("_month_days", dates.recurring_month_days(F.col("applies_month_days"), F.col("_words")))


def _said() -> Column:
    return T.search_text(F.col("restaurant"), F.col("city"), F.col("summary"), F.col("candidate_text"), F.col("validity"), F.col("address"), F.col("details"), F.col("tags"), F.col("categories"))


def _place() -> Column:
    return T.location_key(F.col("restaurant"), F.col("address"), F.col("city"))


def _day(spec: QuerySpec, now: Column) -> Column:
    return dates.today_name(now) if spec.day == "today" else F.lit(spec.day)


def _available(now: Column, correct: bool) -> Column:
    return dates.available_now(F.col("applies_days"), F.col("_month_days"), F.col("time_window"), F.col("hours"), now, correct)


def _distance(spec: QuerySpec) -> Column:
    if not spec.location:
        return F.lit(float("inf"))
    return prices.miles(F.lit(spec.location[0]), F.lit(spec.location[1]), F.col("latitude"), F.col("longitude"))


def conditions(spec: QuerySpec, now: Column, correct: bool = True) -> list[Column]:
    """The filters that a query sets; only those reach the plan, and plain ones are pushed to the scan."""
    out = [F.col("status") == "active"]
    if spec.restaurant:
        out.append(F.col("restaurant") == spec.restaurant)
    if spec.cities:
        out.append(F.col("city").isin(list(spec.cities)))
    if spec.query:
        out.append(F.col("_words").contains(spec.query.lower()))
    known = F.filter(F.coalesce(F.col("categories"), F.array(F.lit("general"))), lambda c: c.isin(list(TYPES)))
    if spec.types != TYPES:
        out.append(F.when(F.size(known) > 0, F.exists(known, lambda c: c.isin(list(spec.types)) if spec.types else F.lit(False))).otherwise(F.lit(set(spec.types) == set(TYPES))))
    if spec.kinds != KINDS:
        hour = F.array_contains(T.strings(F.col("tags")), "happy_hour") | F.col("_words").rlike(r"happy\s*hour")
        out.append(F.when(hour, F.lit("happy_hour" in spec.kinds)).otherwise(F.lit("other" in spec.kinds)))
    if not spec.chains:
        out.append(~T.matches(T.text_or_empty(F.col("restaurant")), fixed.CHAINS))
    if spec.radius:
        out.append(_distance(spec) <= float(spec.radius))
    if spec.available_now:
        out.append(_available(now, correct))
    if spec.favorites_only:
        out.append(_place().isin(list(spec.favorites)) if spec.favorites else F.lit(False))
    if spec.new_only:
        out.append(dates.is_new(F.col("first_seen").cast("timestamp"), now))
    if spec.day:
        out.append(dates.matches_day(F.col("applies_days"), _day(spec, now)))
        if spec.day == "today":
            out.append(dates.matches_month_day(F.col("_month_days"), now))
    return out


def select(feed: DataFrame, spec: QuerySpec, now: Column, correct: bool = True) -> DataFrame:
    """The offers that a query asks for."""
    return _selected(feed, spec, now, correct).drop("_words", "_month_days")


def _selected(feed: DataFrame, spec: QuerySpec, now: Column, correct: bool) -> DataFrame:
    return whole(feed).where(reduce(lambda a, b: a & b, conditions(spec.settled(), now, correct)))


def groups(feed: DataFrame, spec: QuerySpec, now: Column, best: int = 2, correct: bool = True) -> DataFrame:
    """Places of the selected offers: (key, restaurant, city, score, deals, best, distance, newest, urls).

    One aggregation by place; ``best`` holds the highest ranked offers of each.
    """
    spec = spec.settled()
    score = prices.deal_score(F.col("quality_score"), F.col("tags"), F.col("applies_days"), F.col("time_window"))
    status = dates.open_status(F.col("hours"), now, correct)
    rows = _selected(feed, spec, now, correct).withColumns(
        {"_key": _place(), "_score": score, "_available": _available(now, correct), "_open": status.startswith("Open"), "_miles": _distance(spec), "_today": F.array_contains(T.strings(F.col("applies_days")), _day(spec, now)), "_seen": F.col("first_seen").cast("timestamp")}
    )
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_score"), "summary")))
    out = rows.groupBy(F.col("_key").alias("key")).agg(
        F.min("restaurant").alias("restaurant"),
        F.min("city").alias("city"),
        F.count("*").alias("deals"),
        F.max("_score").alias("top"),
        F.bool_or("_available").alias("available"),
        F.bool_or("_open").alias("open"),
        F.bool_or(F.col("value_label").isNotNull()).alias("valued"),
        F.bool_or("_today").alias("today"),
        F.min("_miles").alias("distance"),
        F.max("_seen").alias("newest"),
        F.array_sort(F.collect_set("source_url")).alias("urls"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= best, F.struct("_rank", "summary")))), lambda x: x["summary"]).alias("best"),
    )
    near = F.when(F.col("distance") < float("inf"), F.greatest(F.lit(0.0), 24 - 3 * F.col("distance"))).otherwise(0.0)
    total = F.col("top") + F.when(F.col("available"), 55).when(F.col("open"), 16).otherwise(0) + F.when(F.col("valued"), 10).otherwise(0) + F.when(F.col("today"), 8).otherwise(0) + near
    return out.withColumn("score", total).drop("top", "available", "open", "valued", "today")


def _order(spec: QuerySpec) -> list[Column]:
    name, city = F.collate("restaurant", "UNICODE"), F.collate("city", "UNICODE")
    keys = {"best": [F.desc("score"), name], "newest": [F.desc_nulls_last("newest"), name], "distance": [F.asc("distance"), name], "alpha": [name, city]}
    return [*keys["alpha" if spec.sort == "distance" and not spec.location else spec.sort], F.col("key")]


def ordered(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """Groups in the order asked for; names compare as a reader would."""
    return found.orderBy(*_order(spec))


def ranked(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """Groups with ``rank``, their place from 1 in the order asked for, over range partitions."""
    rows = queues.ranked(found, _order(spec))
    return rows.withColumn("rank", (F.col("rank") + 1).cast("long"))


def facets(*tables: DataFrame, columns: tuple[str, ...] = ("city", "restaurant")) -> DataFrame:
    """(facet, value): what filters may offer, over tables that have some of the columns."""
    parts = [t.select(F.lit(c).alias("facet"), F.col(c).alias("value")) for t in tables for c in columns if c in t.columns]
    return reduce(DataFrame.union, parts).where("value IS NOT NULL AND value <> ''").distinct()


def name_counts(places: DataFrame) -> DataFrame:
    """Groups with how many share their name; those above one need their street."""
    return places.withColumn("same_name", F.count("*").over(Window.partitionBy("restaurant")))


def mappable(places: DataFrame) -> DataFrame:
    """Places with finite coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return places.where(finite("latitude") & finite("longitude"))
