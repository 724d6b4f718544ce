"""Feed state between runs: carrying, archiving, retention, partition replacement, one whole step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernmill.functions import fixed
from fernmill.functions import text as T
from fernmill.functions import urls
from fernmill.operators import dedupe, offers


def usable_snapshot(snapshot: DataFrame, version: int = fixed.FEED_VERSION) -> DataFrame:
    """A stored feed's rows with an id, none if another version wrote it."""
    return snapshot.where((F.col("feed_version") == version) & F.col("id").isNotNull())


def keep_first_seen(found: DataFrame, previous: DataFrame, key: str = "id", column: str = "first_seen") -> DataFrame:
    """``found`` with the time at which an earlier run first saw each row."""
    old = previous.groupBy(key).agg(F.min(column).alias("_seen"))
    return found.join(old, key, "left").withColumn(column, F.coalesce("_seen", column)).drop("_seen")


def carry_forward(previous: DataFrame, seen: DataFrame, now: Column, key: str = "id", drop_after: int = fixed.DROP_AFTER_DAYS) -> DataFrame:
    """Rows of the last feed that this run didn't see, as stale, until they are too old.

    ``seen`` has the ids that this run found, merged away or rejected.
    """
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(F.col("last_seen").cast("timestamp"), now))) / 86400)).cast("int")
    rows = previous.join(seen.select(key).distinct(), key, "left_anti").withColumn("days_since_seen", days).where(F.col("days_since_seen") <= drop_after)
    return rows.withColumns({"status": F.lit("stale"), "is_stale": F.lit(True), "stale_after_days": F.lit(fixed.STALE_AFTER_DAYS)})


def archive_replaced(feed: DataFrame, scope: list[Column], signature: Column, now: Column, key: str = "id") -> DataFrame:
    """``feed`` with retired_at, retired_reason and canonical_id, null on rows that stay public.

    Within a scope and signature: one active row archives all stale ones and
    takes their earliest first_seen; several active ones archive nothing; of
    stale ones alone the newest stays. Rows without a signature stay as they are.
    """
    rows = feed.withColumn("_sig", signature).withColumns({f"_s{i}": c for i, c in enumerate(scope)})
    group = Window.partitionBy(*(f"_s{i}" for i in range(len(scope))), "_sig")
    active = F.col("status") == "active"
    signed = F.col("_sig") != ""
    # Rows without a signature would be one large group: they never enter a window.
    loose = rows.where(~F.coalesce(signed, F.lit(False)))
    rows = rows.where(signed).withColumns({"_active": F.count_if(active).over(group), "_first": F.min("first_seen").over(group)})
    newest = Window.partitionBy(*(f"_s{i}" for i in range(len(scope))), "_sig").orderBy(active.desc(), F.col("last_seen").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.col(key))
    rows = rows.withColumns({"_n": F.row_number().over(newest), "_head": F.first(key).over(newest)})
    replaced = ~active & (F.col("_active") == 1)
    older = ~active & (F.col("_active") == 0) & (F.col("_n") > 1)
    reason = F.when(replaced, "replaced_by_canonical_offer").when(older, "superseded_stale_variant")
    seen = F.when(active & (F.col("_active") == 1), F.col("_first")).otherwise(F.col("first_seen"))
    done = rows.withColumns({"first_seen": seen, "retired_reason": reason, "retired_at": F.when(reason.isNotNull(), now), "canonical_id": F.when(reason.isNotNull(), F.col("_head"))})
    columns = [*feed.columns, "retired_at", "retired_reason", "canonical_id"]
    empty = loose.withColumns({"retired_at": F.lit(None).cast(done.schema["retired_at"].dataType), "retired_reason": F.lit(None).cast("string"), "canonical_id": F.lit(None).cast(done.schema["canonical_id"].dataType)})
    return done.select(*columns).unionByName(empty.select(*columns))


def update_history(history: DataFrame, retired: DataFrame, now: Column, key: str = "id", days: int = fixed.HISTORY_DAYS) -> DataFrame:
    """History with newly retired rows in place of older ones of the same id, without those past retention."""
    merged = history.where(F.col(key).isNotNull()).join(retired.select(key).distinct(), key, "left_anti").unionByName(retired, allowMissingColumns=True)
    when = F.coalesce(F.col("retired_at").cast("timestamp"), now)
    return merged.where(F.unix_timestamp(when) >= F.unix_timestamp(now) - days * 86400)


def replace_partitions(old: DataFrame, new: DataFrame, partition: str, keys: DataFrame) -> DataFrame:
    """``old`` without the partitions named in ``keys``, and the rows of ``new``."""
    return old.join(keys.select(partition).distinct(), partition, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row"))
    return packed.select("row.*")


def summary(feed: DataFrame) -> DataFrame:
    """Counts of a feed's rows by status."""
    return feed.agg(F.count_if(F.col("status") == "active").alias("active_deals"), F.count_if(F.col("status") == "stale").alias("stale_deals"), F.count("*").alias("total_deals"))


def passes_gate(attempts: DataFrame, ok: str = "ok", share: float = 0.8) -> bool:
    """Whether enough of a scan succeeded to replace what was there."""
    row = attempts.agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("good")).first()
    return row["good"] >= max(1, int(share * row["n"]))


def feed_order() -> list[Column]:
    return [(F.col("status") != "active").asc(), F.col("restaurant").asc(), F.col("validity").asc(), F.col("summary").asc()]


@dataclass
class Step:
    """What one run leaves: the public feed, the newly retired rows, the history, the counts."""

    feed: DataFrame
    retired: DataFrame
    history: DataFrame
    rejected: DataFrame


def run_step(found: DataFrame, previous: DataFrame, history: DataFrame, now: Column, order: str = "ord") -> Step:
    """One incremental step: this run's offers and the last snapshot give the next feed.

    A pure function of its tables and the clock: with the same clock, a step over
    its own result changes nothing. Rejected and merged ids count as seen.
    """
    found = keep_first_seen(found, previous)
    checked = found.withColumn("_ok", offers.verified(found))
    rejected = checked.where(~F.col("_ok")).select("id").distinct()
    kept = found.join(rejected, "id", "left_anti")
    merged = dedupe.greedy_merge(kept, order)
    annotated = offers.annotate(merged)
    seen = annotated.select("id").union(annotated.select(F.explode("merged_ids").alias("id"))).union(rejected.select(F.col("id").cast("string")))
    stale = carry_forward(previous, seen, now)
    feed = annotated.unionByName(stale, allowMissingColumns=True)
    scope = [urls.scope(F.col("restaurant"), F.col("city"), F.col("source_url"))]
    judged = archive_replaced(feed, scope, T.signature(F.col("summary")), now)
    public = judged.where("retired_reason IS NULL").drop("retired_at", "retired_reason", "canonical_id")
    retired = judged.where("retired_reason IS NOT NULL")
    return Step(public, retired, update_history(history, retired, now), rejected)


def area_states(areas: DataFrame, saved: DataFrame | None, known: DataFrame, generated_at: Column) -> DataFrame:
    """(city, ord, status, activated_at, last_refreshed): saved states, else active for known cities, else queued."""
    known = known.select("city").distinct().withColumn("_known", F.lit(True))
    rows = areas.join(known, "city", "left")
    fresh = F.when(F.col("_known"), generated_at)
    if saved is None:
        return rows.select("city", "ord", F.when(F.col("_known"), "active").otherwise("queued").alias("status"), fresh.alias("activated_at"), fresh.alias("last_refreshed"))
    old = saved.select("city", F.col("status").alias("_s"), F.col("activated_at").alias("_a"), F.col("last_refreshed").alias("_r"))
    rows = rows.join(old, "city", "left")
    pick = lambda a, b: F.when(F.col("_s").isNotNull(), F.col(a)).otherwise(b)
    return rows.select("city", "ord", F.coalesce("_s", F.when(F.col("_known"), "active").otherwise("queued")).alias("status"), pick("_a", fresh).alias("activated_at"), pick("_r", fresh).alias("last_refreshed"))


def due_areas(states: DataFrame, now: Column, most: int = 1, activate_days: int = 7, refresh_days: int = 35, force: bool = False, migration: bool = False) -> DataFrame:
    """Areas to scan now: queued ones when an activation is due (by date), else stale ones (by time), oldest first."""
    facts = states.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.max(F.when(F.col("status") == "active", F.col("activated_at").cast("timestamp"))).alias("latest"))
    rows = states.crossJoin(F.broadcast(facts))  # one row
    activation = (F.col("queued") > 0) & (F.lit(migration) | F.col("latest").isNull() | (F.to_date(now) >= F.to_date(F.col("latest") + F.expr(f"INTERVAL {activate_days} DAYS"))))
    queued, active = F.col("status") == "queued", F.col("status") == "active"
    last = F.col("last_refreshed").cast("timestamp")
    stale = last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= refresh_days * 86400)
    if force:
        chosen, rank = F.when(F.col("queued") > 0, queued).otherwise(active), F.col("ord")
    else:
        chosen, rank = F.when(activation, queued).otherwise(active & stale), F.when(activation, F.lit(0)).otherwise(F.coalesce(F.unix_timestamp(last), F.lit(-1)))
    return rows.where(chosen).orderBy(rank, "ord").limit(max(1, most)).select(*states.columns)


def next_due(states: DataFrame, now: Column, activate_days: int = 7, refresh_days: int = 35) -> DataFrame:
    """One row: when the next activation or refresh is due."""
    active = F.col("status") == "active"
    row = states.agg(
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.max(F.when(active, F.col("activated_at").cast("timestamp"))).alias("latest"),
        F.min(F.when(active, F.col("last_refreshed").cast("timestamp"))).alias("oldest"),
    )
    activation = F.when(F.col("queued") > 0, F.coalesce("latest", now) + F.expr(f"INTERVAL {activate_days} DAYS"))
    refresh = F.col("oldest") + F.expr(f"INTERVAL {refresh_days} DAYS")
    return row.select(F.coalesce(F.least(activation, refresh), now + F.expr("INTERVAL 1 DAY")).alias("next_refresh_at"))
