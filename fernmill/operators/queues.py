"""Bounded work queues: fairness, rotation, quotas, budgets, cache hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernmill.functions import dates, fixed
from fernmill.functions.fixed import rx
from fernmill.sources.stored import stored

RENDERS_PER_RUN = 8
TEXT_PAGES, VISUAL_PAGES, VISUAL_CANDIDATES = 30, 4, 16
SITES, LOGOS = 12, 20
ASSETS_PER_PAGE, PAGE_BYTES = 3, 11_000_000
REFRESH_LOGO_DAYS, RETRY_LOGO_DAYS = 90, 14


def rank(confidence: Column) -> Column:
    """Reported pages first, then sure ones."""
    return F.when(confidence == "reported", 0).when(confidence == "high", 1).otherwise(2)


def page_order(confidence: Column, name: Column, url: Column) -> list[Column]:
    return [rank(confidence), F.lower(name), url]


def fair(rows: DataFrame, who: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with ``turn``: everyone's first before anyone's second, by ``order`` otherwise."""
    n = F.row_number().over(Window.partitionBy(*who).orderBy(*order))
    return rows.withColumn("turn", F.when(n > 1, 1).otherwise(0))


def ranked(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 in a total order, without one task that sorts them all.

    Rows are range-partitioned and sorted there; a place is one's number in its
    partition plus the rows of the partitions before. Rows that tie in ``order``
    fall in any order. The sorted rows are written to the shared folder, which
    fixes them.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, "ranked").withColumn("_part", F.shiftright("_at", 33)).withColumn("_within", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))  # as many rows as there are partitions
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_rows")
    return placed.join(F.broadcast(counts), "_part").withColumn("rank", F.col("_before") + F.col("_within")).drop("_part", "_within", "_at", "_before")


def rotated(rows: DataFrame, first: Column, order: list[Column | str], day: Column, step: int = RENDERS_PER_RUN, parts: Column | None = None) -> DataFrame:
    """``rows`` with ``place``: those that come ``first`` in order, then the rest turned by the day.

    All rows are one queue, ranked over range partitions; or one for each value of
    ``parts``, each as short as a task can sort.
    """
    ordinary = F.coalesce(~first, F.lit(True))
    turned = dates.ordinal_day(day) * step
    if parts is None:
        queue = ranked(rows.withColumn("_ordinary", ordinary), ["_ordinary", *order])
        head, n = queue.agg(F.count_if(~F.col("_ordinary")), F.count_if("_ordinary")).first()
        at = F.col("rank") - head
        return queue.withColumn("place", F.when(F.col("_ordinary"), head + F.pmod(at - turned % max(n, 1), F.lit(max(n, 1)))).otherwise(F.col("rank"))).drop("_ordinary", "rank")
    own = Window.partitionBy(parts, ordinary)
    n, at = F.count("*").over(own), F.row_number().over(own.orderBy(*order)) - 1
    head = F.count_if(~ordinary).over(Window.partitionBy(parts))
    return rows.withColumn("place", F.when(ordinary, head + F.pmod(at - turned % n, n)).otherwise(at))


def top(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first rows by ``order``; a partial top-k in every task, then one of the tops."""
    return rows.orderBy(*order).limit(most)


def first_rows(rows: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each group; tasks send no more of a group than that."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def split_quota(rows: DataFrame, who: list[str], order: list[Column | str], most: int) -> DataFrame:
    """``rows`` with ``now``: whether each is among its group's first ``most``."""
    n = F.row_number().over(Window.partitionBy(*who).orderBy(*order))
    return rows.withColumn("now", n <= most)


def until_calls(rows: DataFrame, who: list[str], order: list[Column | str], costs: Column, most: int = VISUAL_PAGES) -> DataFrame:
    """Rows up to where ``most`` costly ones have gone before; cached rows after that wait too."""
    before = Window.partitionBy(*who).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_spent", F.coalesce(F.sum(costs.cast("int")).over(before), F.lit(0))).where(F.col("_spent") < most).drop("_spent")


def fit_budget(items: Column, size: str, hash_: str | None = None, most: int = ASSETS_PER_PAGE, budget: int = PAGE_BYTES) -> Column:
    """Of an array in order, the items that still fit: one too large is passed over, not the end."""
    kind = F.struct(F.filter(items, lambda x: F.lit(False)).alias("kept"), F.lit(0).cast("long").alias("used"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["kept"]) < most) & (a["used"] + x[size] <= budget)
        if hash_:
            fits &= ~F.exists(a["kept"], lambda k: k[hash_] == x[hash_])
        return F.when(fits, F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["used"] + x[size]).cast("long").alias("used"))).otherwise(a)

    return F.aggregate(items, kind, step, lambda a: a["kept"])


def reusable_text(content_hash: Column, previous_hash: Column, previous_status: Column, issue: Column, previous_issue: Column) -> Column:
    """Whether a page's last extraction still stands."""
    same = (content_hash != "") & (content_hash == previous_hash) & previous_status.isin("ok", "no_deals")
    return F.coalesce(same & (issue.isNull() | issue.eqNullSafe(previous_issue)), F.lit(False))


def reusable_visual(visual_hash: Column, previous_hash: Column, previous_status: Column, previous_version: Column) -> Column:
    same = (visual_hash != "") & (visual_hash == previous_hash) & previous_status.isin("verified", "no_deals") & (previous_version == fixed.VISUAL_VERSION)
    return F.coalesce(same, F.lit(False))


def needs_render(url: Column, context: Column) -> Column:
    """Pages that say too little as they are served."""
    return ~F.coalesce(url.rlike(rx(r"\.pdf(?:$|[?#])")), F.lit(False)) & ((F.length(context) < 240) | ~F.coalesce(context.rlike(rx(fixed.VALUE_SIGNAL)), F.lit(False)))


def visual_order(confidence: Column, recheck: Column, checked_at: Column, best_score: Column, name: Column, url: Column) -> list[Column]:
    return [
        F.when(rank(confidence) == 0, 0).otherwise(1),
        F.when(recheck, 0).otherwise(1),
        F.coalesce(checked_at, F.lit("")),
        -F.coalesce(best_score, F.lit(0)),
        rank(confidence),
        F.lower(name),
        url,
    ]


def logo_queue(sites: DataFrame, now: Column, most: int = LOGOS, force: bool = False) -> DataFrame:
    """Sites whose logo is due: (host, active, has_logo, status, checked_at), small places and live offers first."""
    days = F.when(F.col("status") == "missing", RETRY_LOGO_DAYS).otherwise(REFRESH_LOGO_DAYS)
    checked = F.coalesce(F.unix_timestamp(F.col("checked_at").cast("timestamp")), F.lit(-62135596800))
    due = F.lit(force) | (checked < F.unix_timestamp(now) - days * 86400)
    order = [F.col("host").rlike("(?i)" + fixed.CHAIN_HOST), ~F.col("active"), F.col("has_logo"), checked, F.col("host")]
    return top(sites.where(due), order, most)


def route(fetched: DataFrame, visual: DataFrame, previous: DataFrame, key: str = "key") -> DataFrame:
    """What becomes of each page: a new visual result, the known visual one, the known text, pending or failed, in that order.

    ``fetched`` has key, context, content_hash, n_assets and report_issue,
    ``visual`` the keys with a result, ``previous`` content_hash, status,
    fetch_mode, visual_status and report_issue.
    """
    v = visual.select(key, F.lit(True).alias("_visual")).distinct()
    known = ("content_hash", "status", "fetch_mode", "visual_status", "report_issue")
    rows = fetched.join(v, key, "left").join(previous.select(key, *(F.col(c).alias(f"_{c}") for c in known)), key, "left")
    reuse = reusable_text(F.col("content_hash"), F.col("_content_hash"), F.col("_status"), F.col("report_issue"), F.col("_report_issue"))
    shown = (F.col("n_assets") > 0) & (F.col("_fetch_mode") == "visual") & F.col("_visual_status").isin("verified", "no_deals")
    way = F.when(F.col("_visual"), "visual").when(shown, "cached_visual").when(reuse, "cached_text").when(F.coalesce("context", F.lit("")) != "", "pending").otherwise("fetch_failed")
    return rows.withColumn("route", way).drop("_visual", *(f"_{c}" for c in known))
