"""The registered queries over the offer operators, each with the same thing in DuckDB's SQL.

Offer queries run on the ``offers`` view over ``part``; feed-state queries treat
the last event of each user and type as a feed row; documents and pages give
texts and HTML.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernmill.functions import dates, fixed, html, prices, urls
from fernmill.functions import text as T
from fernmill.operators import dedupe, discovery, queues, serve, state, windows
from fernmill.operators import offers as O
from fernmill.plans.offers import SQL as OFFERS_SQL
from fernmill.plans.offers import offers as offers_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The clock of the queries: a Tuesday afternoon, and the last day of events.
NOW = "2024-01-30 15:30:00"
SPLIT = "2024-01-29 00:00:00"
HERE = (33.69, -117.98)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers_view(_read(spark, sf_dir, "part"))


def _now(value: str = NOW):
    return F.to_timestamp(F.lit(value))


def _q(pattern: str) -> str:
    """A pattern as an SQL literal, ignoring case."""
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with all that is derived from their summaries."""
    rows = _offers(spark, sf_dir).withColumn("text", T.normalize_line(F.col("summary")))
    return rows.withColumns(
        {
            "tags": T.detect_tags(F.col("text")),
            "categories": T.categories(F.col("text")),
            "applies_days": dates.extract_days(F.col("text")),
            "time_window": dates.time_window(F.col("text")),
            "candidate_text": F.col("text"),
            "details": F.array().cast(T.STRINGS),
            "source_evidence": F.array().cast(T.STRINGS),
        }
    )


_DAYS_SQL = f"""CASE WHEN {_like("summary", r"\b(?:daily|every day|everyday)\b")} THEN ['{"','".join(fixed.DAYS)}']
    WHEN {_like("summary", r"\b(?:weekday|weekdays|mon(?:day)?\s*-\s*fri(?:day)?)\b")} THEN ['{"','".join(fixed.DAYS[:5])}']
    WHEN {_like("summary", r"\bweekends?\b")} THEN ['saturday', 'sunday']
    ELSE list_filter(['{"','".join(fixed.DAYS)}'], lambda d: regexp_matches(lower(summary), '\\b' || d || '\\b')) END"""
_TAG_SQL = "[" + ", ".join(f"CASE WHEN {_like('summary', p)} THEN '{t}' END" for t, p in fixed.TAGS.items()) + "]"
_LABEL_SQL = rf"""CASE WHEN regexp_matches(summary, '(?i)\b\d{{1,3}}\s*%\s*off\b') THEN regexp_extract(summary, '(?i)\b(\d{{1,3}})\s*%\s*off\b', 1) || '% off'
    WHEN regexp_matches(summary, '(?i)\b(?:half[ -]priced?|1/2\s*off)\b') THEN '50% off' WHEN regexp_matches(summary, '(?i)\bbogo\b') THEN 'BOGO'
    WHEN regexp_matches(summary, '(?i)\b(?:2\s*[- ]?for\s*[- ]?1|two\s+for\s+one)\b') THEN '2-for-1' WHEN regexp_matches(summary, '(?i)\bfree\b') THEN 'Free'
    WHEN regexp_matches(summary, '\$\s*\d+') THEN '$' || regexp_extract(summary, '\$\s*(\d+)', 1) END"""
_FULL_SQL = f"""{OFFERS_SQL}, o AS (SELECT *, list_filter({_TAG_SQL}, lambda t: t IS NOT NULL) AS tags, {_DAYS_SQL} AS days, {_LABEL_SQL} AS value_label,
    {_like("summary", fixed.FOOD)} AS food, {_like("summary", fixed.DRINK)} AS drink, CASE WHEN summary LIKE '%3-6 pm' THEN '3 PM - 6 PM' END AS time_window,
    {_like("summary", fixed.CONCRETE)} AS concrete FROM offers),
q AS (SELECT *, greatest(0, least(100, 25 + CASE WHEN list_has_any(tags, ['percent_off', 'bogo', 'free']) THEN 25 ELSE 0 END + CASE WHEN value_label IS NOT NULL THEN 15 ELSE 0 END
    + CASE WHEN list_has_any(tags, ['happy_hour', 'weekday_special']) THEN 10 ELSE 0 END + CASE WHEN len(days) > 0 THEN 8 ELSE 0 END + CASE WHEN time_window IS NOT NULL THEN 7 ELSE 0 END
    - CASE WHEN concrete THEN 0 ELSE 15 END)) AS quality_score FROM o)"""


@query(f"WITH {OFFERS_SQL} SELECT offer_id, unnest(list_filter({_TAG_SQL}, lambda t: t IS NOT NULL)) AS tag FROM offers")
def tag_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir).select("offer_id", F.explode(T.detect_tags(F.col("summary"))).alias("tag"))


@query(
    f"WITH {_FULL_SQL} SELECT offer_id, CASE WHEN food AND drink THEN 'food,drink' WHEN food THEN 'food' WHEN drink THEN 'drink' ELSE 'general' END AS categories, "
    "CASE WHEN food AND drink THEN 'Food + drink' WHEN food THEN 'Food' WHEN drink THEN 'Drink' ELSE 'General' END AS label FROM o"
)
def classify_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.categories(F.col("summary"))
    return _offers(spark, sf_dir).select("offer_id", F.array_join(c, ",").alias("categories"), T.category_label(c).alias("label"))


@query(f"WITH {_FULL_SQL} SELECT offer_id, value_label FROM o")
def value_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast(T.STRINGS)
    return _offers(spark, sf_dir).select("offer_id", prices.value_label(F.col("summary"), empty, empty, T.normalize_line(F.col("summary"))).alias("value_label"))


@query(f"WITH {_FULL_SQL} SELECT offer_id, array_to_string(days, ',') AS days, CASE len(days) WHEN 7 THEN 'Every day' WHEN 5 THEN 'Mon-Fri' WHEN 1 THEN 'Tue' END AS label FROM o")
def extract_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dates.extract_days(F.col("summary"))
    return _offers(spark, sf_dir).select("offer_id", F.array_join(d, ",").alias("days"), dates.day_label(d).alias("label"))


@query(f"WITH {_FULL_SQL} SELECT offer_id, time_window, CASE WHEN time_window IS NOT NULL THEN '900-1080' ELSE '' END AS minutes FROM o")
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = dates.time_window(F.col("summary"))
    ranges = F.transform(dates.time_ranges(w), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return _offers(spark, sf_dir).select("offer_id", w.alias("time_window"), F.array_join(ranges, ";").alias("minutes"))


@query(
    f"""WITH {_FULL_SQL} SELECT offer_id, coalesce(nullif(concat_ws(', ', CASE len(days) WHEN 7 THEN 'Every day' WHEN 5 THEN 'Mon-Fri' WHEN 1 THEN 'Tue' END, time_window), ''), 'Check source') AS validity FROM o"""
)
def validity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir).select("offer_id", dates.validity(F.col("applies_days"), F.col("time_window")).alias("validity"))


@query(f"WITH {_FULL_SQL} SELECT offer_id, quality_score::INTEGER AS quality_score, value_label FROM q")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.annotate(_full(spark, sf_dir)).select("offer_id", "quality_score", "value_label")


_DISCOUNT_SQL = f"(list_has_any(tags, ['percent_off', 'bogo', 'happy_hour', 'free']) OR {_like('summary', fixed.EXPLICIT_DISCOUNT)})"


@query(
    f"WITH {_FULL_SQL} SELECT offer_id, summary FROM o WHERE NOT {_like('summary', fixed.NOT_DINING)} AND ({_DISCOUNT_SQL} "
    f"OR (len(days) > 0 AND (food OR drink) AND regexp_matches(summary, '\\$\\s*\\d+')) OR (concrete AND (food OR drink OR len(days) > 0)))"
)
def verified_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _full(spark, sf_dir)
    return rows.where(O.verified(rows)).select("offer_id", "summary")


@query(f"WITH {_FULL_SQL} SELECT offer_id FROM o WHERE {_DISCOUNT_SQL} OR (len(days) > 0 AND list_contains(tags, 'dollar_amount') AND (food OR drink) AND {_like('summary', fixed.PROMO_CONTEXT)})")
def publishable_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir).where(T.is_publishable(F.col("candidate_text"), F.col("tags"), F.col("categories"), F.col("applies_days"))).select("offer_id")


_STOP_SQL = "['" + "','".join(fixed.SIGNATURE_STOP) + "']"


@query(
    rf"WITH {OFFERS_SQL} SELECT offer_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(summary), '\$\s*\d+(?:\.\d{{1,2}})?(?:\s*[-–—]\s*\$?\s*\d+(?:\.\d{{1,2}})?)?', ' ', 'g'), "
    rf"'\b\d+(?:\.\d+)?\s*(?:percent|%)\b', ' ', 'g'), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP_SQL}, w)), ' ') AS signature FROM offers"
)
def promo_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir).select("offer_id", T.signature(F.col("summary")).alias("signature"))


@query(
    rf"WITH {OFFERS_SQL} SELECT offer_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(summary, '\$\s*\d+(?:\.\d{{1,2}})?', ' ', 'g'), '(?i)\b(?:food|drinks?|and|items?|offers?|menu)\b', ' ', 'g'), '\s+', ' ', 'g'), ' -|•')) AS family FROM offers"
)
def promo_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir).select("offer_id", T.family(F.col("summary")).alias("family"))


_KEY_SQL = "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '\\b(?:restaurant|bar|grill|cafe|the)\\b', '', 'g'), ' +', ' ', 'g')) || '|' || lower({1})"


@query(f"SELECT c_custkey AS id, {_KEY_SQL.format('c_name', 'c_mktsegment')} AS key FROM customer UNION ALL SELECT s_suppkey, {_KEY_SQL.format('s_name', 'n_name')} FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def restaurant_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.restaurant_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))
    s = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return c.unionByName(s.select(F.col("s_suppkey").alias("id"), T.restaurant_key(F.col("s_name"), F.col("n_name")).alias("key")))


@query(f"WITH {OFFERS_SQL} SELECT offer_id, left(sha1(restaurant || '|' || city || '|' || trim(regexp_replace(lower(summary), '\\s+', ' ', 'g'))), 16) AS id, left(sha1(offer_id::VARCHAR || '|' || city), 20) AS page_key FROM offers")
def stable_deal_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir).select("offer_id", urls.offer_id(F.col("restaurant"), F.col("city"), F.col("summary")).alias("id"), urls.page_key(F.col("offer_id").cast("string"), F.col("city")).alias("page_key"))


_HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, {_HOST_SQL} AS host, regexp_matches({_HOST_SQL}, '(^|\\.)(facebook\\.com|instagram\\.com|linktr\\.ee|opentable\\.com|toasttab\\.com|yelp\\.com)$') AS blocked FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("host"), urls.is_blocked(F.col("url")).alias("blocked"))


_PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY_SQL = "CASE WHEN regexp_extract(url, '^[^#]*?\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^[^#]*?\\?([^#]*)', 1) ELSE '' END"


@query(
    f"SELECT page_id, 'https://' || {_HOST_SQL} || CASE WHEN {_PATH_SQL} IN ('', '/') THEN '/' ELSE rtrim(regexp_replace({_PATH_SQL}, '/+', '/', 'g'), '/') END || {_QUERY_SQL} AS published, "
    f"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN {_PATH_SQL} = '' THEN '/' ELSE {_PATH_SQL} END || {_QUERY_SQL} AS page_url FROM pages"
)
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", urls.published_url(F.col("url")).alias("published"), urls.page_url(F.col("url")).alias("page_url"))


@query(
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g') AS h FROM pages),
n AS (SELECT page_id, unnest(string_split_regex(h, '<[^>]*>|[\r\n]+')) AS line FROM t)
SELECT page_id, count(*) AS n_lines FROM n WHERE trim(line, E' -|•\t') <> '' GROUP BY page_id"""
)
def html_visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "pages").select("page_id", F.explode(html.visible_lines(F.col("html"))).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("l")).select("page_id", "l.href")


@query()
def specials_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages whose words lead on; the pages have no specials, so their own 'the' stands in."""
    pages = _read(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", F.explode(html.links(F.col("html"))).alias("l"))
    rows = rows.select("page_id", urls.page_url(html.joined(F.col("url"), F.col("l.href"))).alias("link"), urls.host("url").alias("host"), F.col("l.label").alias("label"))
    return rows.where(urls.host("link") == F.col("host")).groupBy("host").agg(F.countDistinct("link").alias("links"), F.min("label").alias("first_label"))


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows


_SIGNAL = r"(copyright|all rights)|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
s AS (SELECT *, max(CASE WHEN {_like("line", _SIGNAL)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 5 FOLLOWING) AS near FROM l)
SELECT doc_id, pos::INTEGER AS pos, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INTEGER AS number, line FROM s WHERE near = 1"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _doc_lines(spark, sf_dir)
    found = windows.lines_in_context(lines, "doc_id", F.col("line").rlike("(?i)" + _SIGNAL))
    return found.select("doc_id", "pos", "number", "line")


@query()
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offer candidates where each place's offers are the lines of its page."""
    lines = _offers(spark, sf_dir).select(F.concat_ws("|", "restaurant", "city").alias("page"), F.col("offer_id").alias("pos"), F.col("summary").alias("line"))
    found = windows.candidates(lines, "page")
    return found.select("page", "pos", "summary", F.size("details").alias("n_details"), F.array_join("tags", ",").alias("tags"), F.length("text").alias("n_chars"))


@query(
    r"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM documents)
SELECT doc_id, length(key)::INTEGER AS key_chars FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1"""
)
def dedupe_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", T.word_key(F.col("text")).alias("key"))
    # The text goes no further than its hash: partial minima by key, not a sort of texts.
    firsts = rows.groupBy(F.sha2("key", 256).alias("h")).agg(F.min_by(F.struct("doc_id", F.length("key").alias("n")), "doc_id").alias("v"))
    return firsts.select("v.doc_id", F.col("v.n").alias("key_chars"))


_TOKENS_SQL = f"list_distinct(list_filter(regexp_extract_all(lower(summary), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP_SQL}, w)))"


@query(
    f"""WITH {_FULL_SQL}, t AS (SELECT offer_id, restaurant, city, {_TOKENS_SQL} AS tok, trim(regexp_replace(lower(summary), '[^a-z0-9_]+', ' ', 'g')) AS key, value_label,
    list_distinct(regexp_extract_all(lower(summary), {_q(fixed.VARIANT)})) AS var FROM o),
p AS (SELECT a.offer_id AS "left", b.offer_id AS "right", len(list_intersect(a.tok, b.tok)) AS nc, len(a.tok) AS na, len(b.tok) AS nb, a.key = b.key AS same, a.value_label = b.value_label AS worth,
    len(list_filter(list_intersect(a.tok, b.tok), lambda w: NOT regexp_matches(w, '^[0-9]+$'))) > 0 AS word, len(a.var) > 0 AND len(b.var) > 0 AND NOT list_has_any(a.var, b.var) AS other
    FROM t a JOIN t b ON a.restaurant = b.restaurant AND a.city = b.city AND a.offer_id < b.offer_id)
SELECT "left", "right", round(nc / (na + nb - nc), 6) AS similarity FROM p
WHERE NOT other AND (same OR (coalesce(worth, false) AND na > 0 AND nb > 0 AND (nc / (na + nb - nc) >= 0.58 OR ((nc = na OR nc = nb) AND word))))"""
)
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.annotate(_full(spark, sf_dir).withColumn("time_window", F.lit(None).cast("string")))
    return dedupe.duplicate_pairs(rows, "offer_id").select("left", "right", F.round("similarity", 6).alias("similarity"))


#: The merge as a fold in SQL: each place's leaders are a list that its next offer joins or extends.
_MERGE_SQL = rf"""WITH RECURSIVE {_FULL_SQL.removeprefix("WITH ")},
marked AS (
  SELECT restaurant, city, row_number() OVER (PARTITION BY restaurant, city ORDER BY offer_id) AS n,
    {{'id': offer_id::VARCHAR, 'summary': summary, 'words': trim(regexp_replace(lower(summary), '[^a-z0-9_]+', ' ', 'g')), 'at': lower(coalesce(time_window, '')),
      'variants': list_distinct(regexp_extract_all(lower(summary), '\b(?:monday|mon|tuesday|tue|wednesday|wed|thursday|thu|friday|fri|saturday|sat|sunday|sun|breakfast|brunch|lunch|dinner|late\s+night)\b')),
      'tokens': list_distinct(list_filter(regexp_extract_all(lower(summary), '[a-z0-9]+'), lambda w: len(w) > 1 AND w NOT IN ('a', 'an', 'and', 'deal', 'deals', 'drink', 'drinks', 'food', 'foods', 'menu', 'offer', 'offers', 'special', 'specials', 'the'))),
      'label': value_label, 'merged': []::VARCHAR[]}} AS r
  FROM o),
fold AS (
  SELECT DISTINCT restaurant, city, 0::BIGINT AS n, list_filter([r], lambda x: FALSE) AS leaders FROM marked WHERE n = 1
  UNION ALL
  SELECT restaurant, city, n, CASE WHEN spot IS NULL OR spot = 0 THEN leaders || [r] ELSE leaders[:spot - 1] || [
      {{'id': CASE WHEN richer THEN r.id ELSE m.id END, 'summary': CASE WHEN richer THEN r.summary ELSE m.summary END, 'words': CASE WHEN richer THEN r.words ELSE m.words END, 'at': CASE WHEN richer THEN r.at ELSE m.at END,
        'variants': CASE WHEN richer THEN r.variants ELSE m.variants END, 'tokens': CASE WHEN richer THEN r.tokens ELSE m.tokens END, 'label': CASE WHEN richer THEN coalesce(r.label, m.label) ELSE coalesce(m.label, r.label) END,
        'merged': m.merged || [CASE WHEN richer THEN m.id ELSE r.id END]}}] || leaders[spot + 1:] END
  FROM (SELECT *, leaders[spot] AS m, length(r.summary) > length(leaders[spot].summary) AS richer FROM (
    SELECT f.restaurant, f.city, k.n, f.leaders, k.r, list_position(list_transform(f.leaders, lambda l: NOT (l.at <> '' AND k.r.at <> '' AND l.at <> k.r.at)
      AND NOT (len(l.variants) > 0 AND len(k.r.variants) > 0 AND NOT list_has_any(l.variants, k.r.variants))
      AND (l.words = k.r.words OR coalesce(l.label = k.r.label AND len(l.tokens) > 0 AND len(k.r.tokens) > 0
        AND (len(list_intersect(l.tokens, k.r.tokens)) >= 0.58 * len(list_distinct(l.tokens || k.r.tokens))
          OR (len(list_intersect(l.tokens, k.r.tokens)) = least(len(l.tokens), len(k.r.tokens)) AND len(list_filter(list_intersect(l.tokens, k.r.tokens), lambda w: NOT regexp_matches(w, '^[0-9]+$'))) > 0)), FALSE))), TRUE) AS spot
    FROM fold f JOIN marked k ON k.restaurant = f.restaurant AND k.city = f.city AND k.n = f.n + 1) a) b),
done AS (SELECT restaurant, city, unnest(leaders) AS l FROM fold QUALIFY n = max(n) OVER (PARTITION BY restaurant, city))
SELECT l.id AS id, restaurant, city, l.summary AS summary, len(l.merged)::INTEGER AS n_merged, array_to_string(l.merged, ',') AS merged_ids FROM done"""


@query(_MERGE_SQL)
def split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge with every place split into the connected parts of its links first."""
    return _merged(spark, sf_dir, place_rows=0)


@query(_MERGE_SQL)
def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


def _merged(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = _full(spark, sf_dir).select(F.col("offer_id").cast("string").alias("id"), F.col("offer_id").alias("ord"), "restaurant", "city", "summary", "details", "source_evidence", "time_window")
    merged = dedupe.greedy_merge(rows, **options)
    return merged.select("id", "restaurant", "city", "summary", F.size("merged_ids").alias("n_merged"), F.array_join("merged_ids", ",").alias("merged_ids"))


@query(
    f"""WITH {_FULL_SQL}, h AS (SELECT restaurant || '|' || city AS page, offer_id AS ord, floor(price / 100)::BIGINT AS tier, summary, days FROM o WHERE list_contains(tags, 'happy_hour')),
g AS (SELECT page, count(*) AS n, min(ord) AS ord, min(tier) AS low, max(tier) AS high, list('$' || tier || ': ' || summary ORDER BY tier, ord) AS lines, flatten(list(days)) AS all_days FROM h GROUP BY page)
SELECT page, ord, '$' || low || '-$' || high || ' Happy Hour' AS summary, array_to_string(lines[:8], '; ') AS details,
    array_to_string(list_filter(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], lambda d: list_contains(all_days, d)), ',') AS days, n::INTEGER AS grouped_deals FROM g WHERE high > low
UNION ALL SELECT page, h.ord, '$' || tier || ' Happy Hour', summary, array_to_string(days, ','), NULL FROM h JOIN g USING (page) WHERE high = low"""
)
def consolidated_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price tiers of each place's happy hour, made from its offers' prices."""
    rows = _full(spark, sf_dir).where(F.array_contains("tags", "happy_hour"))
    rows = rows.select(
        F.concat_ws("|", "restaurant", "city").alias("page"), F.col("offer_id").alias("ord"), F.concat(F.lit("$"), F.floor(F.col("price") / 100).cast("bigint").cast("string"), F.lit(" Happy Hour")).alias("summary"),
        F.array("summary").alias("details"), "applies_days", F.array().cast("array<int>").alias("applies_month_days"), "time_window", "categories", F.lit(None).cast("string").alias("valid_through"), "source_evidence", F.lit(0.9).alias("ai_confidence"),
    )
    made = dedupe.consolidate(rows)
    return made.select("page", "ord", "summary", F.array_join("details", "; ").alias("details"), F.array_join("applies_days", ",").alias("days"), "grouped_deals")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, as feed rows."""
    rows = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_seen"), F.min("ts").alias("first_seen"), F.count("*").alias("n"))
    return rows.withColumn("id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))


_SNAP_SQL = "s AS (SELECT user_id, event_type, max(ts) AS last_seen, min(ts) AS first_seen, count(*) AS n, user_id::VARCHAR || '|' || event_type AS id FROM events GROUP BY ALL)"


@query(
    f"""WITH {_SNAP_SQL}, seen AS (SELECT DISTINCT user_id::VARCHAR || '|' || event_type AS id FROM events WHERE ts >= TIMESTAMP '{SPLIT}'), old AS (SELECT user_id, event_type, max(ts) AS last_seen, user_id::VARCHAR || '|' || event_type AS id FROM events WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY ALL)
SELECT id, 'stale' AS status, greatest(0, floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(last_seen))) / 86400))::INTEGER AS days_since_seen FROM old WHERE id NOT IN (SELECT id FROM seen)"""
)
def carry_forward_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").withColumn("id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    split = F.to_timestamp_ntz(F.lit(SPLIT))
    old = events.where(F.col("ts") < split).groupBy("id").agg(F.max("ts").alias("last_seen"))
    return state.carry_forward(old, events.where(F.col("ts") >= split), _now()).select("id", "status", "days_since_seen")


@query(
    f"""WITH old AS (SELECT user_id, min(ts) AS first_seen FROM events WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1), new AS (SELECT user_id, min(ts) AS first_seen FROM events WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY 1)
SELECT new.user_id, strftime(coalesce(old.first_seen, new.first_seen), '%Y-%m-%dT%H:%M:%SZ') AS first_seen FROM new LEFT JOIN old USING (user_id)"""
)
def first_seen_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, split = _read(spark, sf_dir, "events"), F.to_timestamp_ntz(F.lit(SPLIT))
    per = lambda df: df.groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    found = state.keep_first_seen(per(events.where(F.col("ts") >= split)), per(events.where(F.col("ts") < split)), "user_id")
    return found.select("user_id", dates.iso(F.col("first_seen")).alias("first_seen"))


_STATUS_SQL = f"CASE WHEN last_seen >= TIMESTAMP '{SPLIT}' THEN 'active' ELSE 'stale' END"


@query(
    f"""WITH {_SNAP_SQL}, f AS (SELECT *, {_STATUS_SQL} AS status, user_id % 25 AS scope, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS sig FROM s),
w AS (SELECT *, count(*) FILTER (WHERE status = 'active') OVER g AS act, min(first_seen) OVER g AS least_seen,
    row_number() OVER (PARTITION BY scope, sig ORDER BY status = 'active' DESC, last_seen DESC, first_seen DESC, id) AS rn,
    first_value(id) OVER (PARTITION BY scope, sig ORDER BY status = 'active' DESC, last_seen DESC, first_seen DESC, id) AS head FROM f WHERE sig <> '' WINDOW g AS (PARTITION BY scope, sig))
SELECT id, CASE WHEN status <> 'active' AND act = 1 THEN 'replaced_by_canonical_offer' WHEN status <> 'active' AND act = 0 AND rn > 1 THEN 'superseded_stale_variant' END AS retired_reason,
    CASE WHEN status <> 'active' AND (act = 1 OR (act = 0 AND rn > 1)) THEN head END AS canonical_id,
    strftime(CASE WHEN status = 'active' AND act = 1 THEN least_seen ELSE first_seen END, '%Y-%m-%dT%H:%M:%SZ') AS first_seen FROM w
UNION ALL SELECT id, NULL, NULL, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') FROM f WHERE sig = ''"""
)
def archive_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _snapshot(spark, sf_dir).withColumn("status", F.when(F.col("last_seen") >= F.to_timestamp_ntz(F.lit(SPLIT)), "active").otherwise("stale"))
    signature = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    judged = state.archive_replaced(feed, [F.col("user_id") % 25], signature, _now())
    return judged.select("id", "retired_reason", "canonical_id", dates.iso(F.col("first_seen")).alias("first_seen"))


@query(
    f"""WITH {_SNAP_SQL}, h AS (SELECT id, last_seen AS retired_at, 0 AS fresh FROM s WHERE event_type <> 'click' UNION ALL SELECT id, first_seen, 1 FROM s WHERE event_type IN ('click', 'view')),
m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY fresh DESC) = 1)
SELECT id, fresh, strftime(retired_at, '%Y-%m-%dT%H:%M:%SZ') AS retired_at FROM m WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(retired_at)) <= 10 * 86400"""
)
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _snapshot(spark, sf_dir)
    old = rows.where("event_type <> 'click'").select("id", F.col("last_seen").alias("retired_at"), F.lit(0).alias("fresh"))
    new = rows.where("event_type IN ('click', 'view')").select("id", F.col("first_seen").alias("retired_at"), F.lit(1).alias("fresh"))
    return state.update_history(old, new, _now(), days=10).select("id", "fresh", dates.iso(F.col("retired_at")).alias("retired_at"))


@query(f"WITH {_SNAP_SQL}, f AS (SELECT {_STATUS_SQL} AS status FROM s) SELECT count(*) FILTER (WHERE status = 'active') AS active_deals, count(*) FILTER (WHERE status = 'stale') AS stale_deals, count(*) AS total_deals FROM f")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.summary(_snapshot(spark, sf_dir).withColumn("status", F.when(F.col("last_seen") >= F.to_timestamp_ntz(F.lit(SPLIT)), "active").otherwise("stale")))


@query(
    f"""WITH {_FULL_SQL} SELECT offer_id, (offer_id % 20) / 20.0 >= 0.5 AND {_like("summary", fixed.VALUE_SIGNAL)} AND NOT {_like("summary", fixed.NOT_DINING)} AND NOT {_like("summary", fixed.NOISE_SUMMARY)}
    AND offer_id % 7 <> 0 AND (concrete OR (len(days) > 0 AND (food OR drink) AND regexp_matches(summary, '\\$\\s*\\d+'))) AND (offer_id % 3 <> 0 OR offer_id % 2 = 0) AS accepted FROM o"""
)
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted offers against their pages: evidence is quoted in other case, every seventh page lacks it, some have expired."""
    rows = _full(spark, sf_dir).withColumns(
        {
            "context": F.when(F.col("offer_id") % 7 == 0, F.lit("nothing here")).otherwise(F.concat(F.lit("Welcome!  "), F.col("summary"), F.lit(" at "), F.col("restaurant"))),
            "evidence": F.array(F.upper("summary")),
            "applies_month_days": F.array().cast("array<int>"),
            "valid_through": F.when((F.col("offer_id") % 3 == 0) & (F.col("offer_id") % 2 == 1), "2024-01-29").when(F.col("offer_id") % 3 == 0, "2024-01-30").otherwise("none"),
            "confidence": (F.col("offer_id") % 20) / 20.0,
        }
    )
    return O.judge_extracted(rows, _now(), 0.5).select("offer_id", "accepted")


@query(
    """WITH inv AS (SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 10 = 0 THEN 'Supplier' ELSE s_name END AS name, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey),
rep AS (SELECT s_suppkey AS issue, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Grill' ELSE '' END AS name, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey),
k AS (SELECT issue, trim(regexp_replace(lower(name), '[^a-z0-9$%]+', ' ', 'g')) AS said, city FROM rep), i AS (SELECT place_id, trim(regexp_replace(lower(name), '[^a-z0-9$%]+', ' ', 'g')) AS called, city FROM inv)
SELECT issue, min(place_id) AS place_id FROM k JOIN i USING (city) WHERE said = called OR starts_with(said, called || ' ') GROUP BY issue HAVING count(*) = 1"""
)
def exactly_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    inventory = rows.select(F.col("s_suppkey").alias("place_id"), F.when(F.col("s_suppkey") % 10 == 0, "Supplier").otherwise(F.col("s_name")).alias("name"), F.col("n_name").alias("city"))
    reports = rows.select(F.col("s_suppkey").alias("issue"), F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " Grill").otherwise("")).alias("name"), F.col("n_name").alias("city"), F.lit("").alias("source"))
    return discovery.match_reports(reports, inventory).select("issue", "place_id")


@query(
    """WITH pg AS (SELECT o_orderkey AS ord, o_custkey AS issue, 'http://www.Example.com//c/' || o_custkey || '/' AS u, o_custkey FROM orders WHERE o_orderstatus = 'F'),
live AS (SELECT o_custkey, count(*) AS deal_count FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT issue, deal_count FROM pg JOIN live USING (o_custkey) QUALIFY row_number() OVER (PARTITION BY issue ORDER BY ord) = 1"""
)
def report_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported pages are finished orders, live offers open ones of the same customer, under another spelling of the address."""
    orders = _read(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string")
    pages = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("issue"), F.concat(F.lit("http://www.Example.com//c/"), key, F.lit("/")).alias("source_url"), F.concat(F.lit("  Customer "), key).alias("restaurant"), F.lit("X").alias("city"), F.lit("ok").alias("status"), F.lit(1).alias("n_deals"))
    feed = orders.where("o_orderstatus = 'O'").select(F.concat(F.lit("https://example.com/c/"), key, F.lit("#top")).alias("source_url"), F.concat(F.lit("customer  "), key).alias("restaurant"), F.lit("x").alias("city"), F.lit("active").alias("status"))
    return discovery.resolutions(pages, feed).select("issue", "deal_count")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) > 1 THEN 1 ELSE 0 END AS turn FROM orders")
def fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.fair(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "turn")


@query(
    """WITH b AS (SELECT p_partkey, p_brand, p_size = 1 AS first FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY p_brand, first) AS n, row_number() OVER (PARTITION BY p_brand, first ORDER BY p_partkey) - 1 AS spot,
    count(*) FILTER (WHERE first) OVER (PARTITION BY p_brand) AS head FROM b)
SELECT p_partkey, (CASE WHEN first THEN spot ELSE head + ((spot - ((DATE '2024-01-30' - DATE '0001-01-01') + 1) * 8 % n) % n + n) % n END)::BIGINT AS place FROM n"""
)
def rotating_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queues.rotated(_read(spark, sf_dir, "part"), F.col("p_size") == 1, ["p_partkey"], F.to_date(F.lit(NOW)), parts=F.col("p_brand"))
    return rows.select("p_partkey", F.col("place").cast("bigint").alias("place"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 30 AS now FROM orders")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.split_quota(_read(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], queues.TEXT_PAGES).select("o_orderkey", "now")


@query(
    """SELECT o_orderkey FROM orders QUALIFY coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4"""
)
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queues.until_calls(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "P")
    return rows.select("o_orderkey")


@query(
    """WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS i FROM lineitem),
r AS (SELECT l_orderkey, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS n, '' AS kept FROM (SELECT DISTINCT l_orderkey FROM l)
UNION ALL SELECT r.l_orderkey, l.i, CASE WHEN r.n < 3 AND r.used + l.q <= 60 THEN r.used + l.q ELSE r.used END, CASE WHEN r.n < 3 AND r.used + l.q <= 60 THEN r.n + 1 ELSE r.n END,
    CASE WHEN r.n < 3 AND r.used + l.q <= 60 THEN r.kept || ',' || l.q ELSE r.kept END FROM r JOIN l ON l.l_orderkey = r.l_orderkey AND l.i = r.i + 1)
SELECT l_orderkey, max(used) AS used, max(n)::INTEGER AS n, substr(arg_max(kept, i), 2) AS kept FROM r GROUP BY l_orderkey"""
)
def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))))
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    kept = rows.withColumn("kept", queues.fit_budget(F.col("items"), "q", budget=60))
    return kept.select("l_orderkey", F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["q"]).alias("used"), F.size("kept").alias("n"), F.array_join(F.transform("kept", lambda x: x["q"].cast("string")), ",").alias("kept"))


@query(
    """WITH a AS (SELECT n_name AS city, 33.6 + n_nationkey * 0.01 AS south, 33.7 + n_nationkey * 0.01 AS north, -118.0::DOUBLE AS west, -117.9::DOUBLE AS east FROM nation),
b AS (SELECT city, south::DOUBLE AS south, west, unnest(range(0, (floor((north::DOUBLE + 1e-6 - south::DOUBLE) / 0.012) + 1)::BIGINT)) AS i, (floor((east + 1e-6 - west) / 0.014) + 1)::BIGINT AS m FROM a),
c AS (SELECT *, unnest(range(0, m)) AS j FROM b) SELECT city, round(south + i * 0.012::DOUBLE, 6) AS latitude, round(west + j * 0.014::DOUBLE, 6) AS longitude FROM c"""
)
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    exact = lambda base: (F.lit(base).cast("decimal(10,2)") + F.col("n_nationkey") * F.lit("0.01").cast("decimal(10,2)")).cast("double")
    areas = nation.select(F.col("n_name").alias("city"), exact("33.6").alias("south"), exact("33.7").alias("north"), F.lit(-118.0).alias("west"), F.lit(-117.9).alias("east"))
    return discovery.grid(areas, 0.012, 0.014)


_MILES_SQL = f"2 * 3958.8 * asin(sqrt(pow(sin(radians(latitude - {HERE[0]}) / 2), 2) + cos(radians({HERE[0]})) * cos(radians(latitude)) * pow(sin(radians(longitude - {HERE[1]}) / 2), 2)))"


@query(f"WITH {OFFERS_SQL}, d AS (SELECT offer_id, {_MILES_SQL} AS miles FROM offers) SELECT offer_id, round(miles, 6) AS miles FROM d WHERE miles <= 5")
def haversine_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _offers(spark, sf_dir).withColumn("miles", prices.miles(F.lit(HERE[0]), F.lit(HERE[1]), F.col("latitude"), F.col("longitude")))
    return rows.where("miles <= 5").select("offer_id", F.round("miles", 6).alias("miles"))


@query("SELECT DISTINCT * FROM (SELECT 'city' AS facet, n_name AS value FROM nation UNION ALL SELECT 'restaurant', c_mktsegment FROM customer UNION ALL SELECT 'city', r_name FROM region UNION ALL SELECT 'restaurant', p_brand FROM part)")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [
        _read(spark, sf_dir, "nation").select(F.col("n_name").alias("city")),
        _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("restaurant")),
        _read(spark, sf_dir, "region").select(F.col("r_name").alias("city")),
        _offers(spark, sf_dir).select("restaurant"),
    ]
    return serve.facets(*tables)


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.annotate(_full(spark, sf_dir)).withColumns({"status": F.lit("active"), "source_url": F.concat(F.lit("https://example.com/"), F.col("offer_id").cast("string"))})


@query(
    f"""WITH {_FULL_SQL} SELECT offer_id FROM o WHERE NOT (food AND false) AND city IN ('City1', 'City3') AND contains(lower(restaurant || ' ' || city || ' ' || summary), 'ring') AND list_contains(tags, 'weekday_special')
    AND (len(days) = 0 OR list_contains(days, 'tuesday')) AND {_MILES_SQL} <= 10 AND (time_window IS NULL OR true)"""
)
def serve_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = serve.QuerySpec(query="ring", cities=("City1", "City3"), radius=10, available_now=True, location=HERE)
    rows = serve.select(_feed(spark, sf_dir), spec, _now())
    return rows.where(F.array_contains("tags", "weekday_special")).select("offer_id")


@query(
    f"""WITH {_FULL_SQL}, d AS (SELECT *, {_MILES_SQL} AS miles, quality_score + CASE WHEN list_contains(tags, 'happy_hour') THEN 4 ELSE 0 END + CASE WHEN list_has_any(tags, ['percent_off', 'bogo', 'free']) THEN 3 ELSE 0 END
    + CASE WHEN len(days) > 0 THEN 2 ELSE 0 END + CASE WHEN time_window IS NOT NULL THEN 1 ELSE 0 END AS score FROM q WHERE len(days) = 0 OR list_contains(days, 'tuesday')),
r AS (SELECT *, row_number() OVER (PARTITION BY restaurant, city ORDER BY score DESC, summary) AS rn FROM d)
SELECT restaurant || '|' || city AS key, count(*) AS deals, round(max(score) + 55 + CASE WHEN count(value_label) > 0 THEN 10 ELSE 0 END + CASE WHEN bool_or(list_contains(days, 'tuesday')) THEN 8 ELSE 0 END + greatest(0, 24 - 3 * min(miles)), 4) AS score,
    string_agg(summary, '; ' ORDER BY rn) FILTER (WHERE rn <= 2) AS best, round(min(miles), 6) AS distance FROM r GROUP BY restaurant, city"""
)
def group_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what places offer on a Tuesday afternoon near here, best first."""
    spec = serve.QuerySpec(location=HERE)
    found = serve.ordered(serve.groups(_feed(spark, sf_dir), spec, _now()), spec)
    return found.select("key", "deals", F.round("score", 4).alias("score"), F.array_join("best", "; ").alias("best"), F.round("distance", 6).alias("distance"))


_HOURS_SQL = """h AS (SELECT user_id, isodow(ts) - 1 AS d, hour(ts) AS o, (hour(ts) + 2) % 24 AS c, row_number() OVER (PARTITION BY user_id, isodow(ts) ORDER BY hour(ts), event_id) AS rn FROM events WHERE event_type = 'signup')"""


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening periods of each user, two hours from every signup."""
    e = _read(spark, sf_dir, "events").where("event_type = 'signup'")
    d, o = F.weekday("ts"), F.hour("ts")
    e = e.select("user_id", d.alias("d"), o.alias("o"), F.row_number().over(Window.partitionBy("user_id", d).orderBy(o, "event_id")).alias("rn"))
    clock = lambda h: F.struct(((F.col("d") + 1) % 7).alias("day"), h.alias("hour"), F.lit(None).cast("int").alias("minute"))
    period = F.struct("d", "rn", clock(F.col("o")).alias("open"), clock((F.col("o") + 2) % 24).alias("close"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(period)).alias("p"))
    return rows.select("user_id", dates.pivot_hours(F.transform("p", lambda x: F.struct(x["open"].alias("open"), x["close"].alias("close")))).alias("hours"))


@query(
    f"""WITH {_HOURS_SQL}, k AS (SELECT * FROM h), g AS (SELECT user_id, d, string_agg(printf('%02d:00-%02d:00', o, c), ',' ORDER BY rn) AS r FROM k GROUP BY ALL)
SELECT user_id, string_agg(list_extract(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], (d + 1)::INTEGER) || ' ' || r, '; ' ORDER BY d) AS hours FROM g GROUP BY user_id"""
)
def hours_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform(F.map_entries("hours"), lambda e: F.concat(e["key"], F.lit(" "), F.array_join(F.transform(e["value"], lambda r: F.concat(r["open"], F.lit("-"), r["close"])), ",")))
    return _periods(spark, sf_dir).select("user_id", F.array_join(shown, "; ").alias("hours"))


@query(
    f"""WITH {_HOURS_SQL}, k AS (SELECT *, d * 1440 + o * 60 AS s, d * 1440 + c * 60 + CASE WHEN c <= o THEN 1440 ELSE 0 END AS e FROM h), t AS (SELECT (isodow(TIMESTAMP '{NOW}') - 1) * 1440 + 15 * 60 + 30 AS m),
f AS (SELECT user_id, arg_min(c, d * 100000 + rn) FILTER (WHERE (m >= s AND m < e) OR (m + 10080 >= s AND m + 10080 < e)) AS cl, arg_min(o, rn) FILTER (WHERE d = 1) AS op FROM k, t GROUP BY user_id)
SELECT user_id, CASE WHEN cl IS NOT NULL THEN 'Open until ' || (CASE WHEN cl % 12 = 0 THEN 12 ELSE cl % 12 END) || (CASE WHEN cl >= 12 THEN 'pm' ELSE 'am' END)
    WHEN op IS NOT NULL THEN 'Closed now, opens ' || (CASE WHEN op % 12 = 0 THEN 12 ELSE op % 12 END) || (CASE WHEN op >= 12 THEN 'pm' ELSE 'am' END) ELSE 'Closed today' END AS status FROM f"""
)
def open_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir).select("user_id", dates.open_status(F.col("hours"), _now()).alias("status"))


@query(f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 90) UNION ALL SELECT event_type, value FROM events WHERE ts >= TIMESTAMP '{SPLIT}' AND event_type IN (SELECT event_type FROM events WHERE value > 90)) GROUP BY 1")
def partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    keys = events.where("value > 90").select("event_type").distinct()
    new = events.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(SPLIT))).join(keys, "event_type", "left_semi")
    out = state.replace_partitions(events, new, "event_type", keys)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b)"""
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    of = lambda kind: events.where(F.col("event_type") == kind).select("user_id").distinct()
    a, b = of("purchase"), of("error")
    count = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count("union", a.union(b).distinct()).unionByName(count("except", a.join(b, "user_id", "left_anti"))).unionByName(count("intersect", a.join(b, "user_id", "left_semi")))


@query("SELECT event_type, (json_extract(props, '$.k')::BIGINT) // 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return _read(spark, sf_dir, "events").groupBy("event_type", F.floor(k / 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ':' || length(text), '>' ORDER BY turn, role) AS form FROM conversations GROUP BY conv_id")
def conversations_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("t"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["n"].cast("string"))), ">").alias("form"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_wins(_read(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query(
    f"""WITH cur AS (SELECT c_custkey AS ord, c_name AS name, c_mktsegment AS city, 'https://x.com/' || c_custkey AS url FROM customer WHERE c_custkey % 3 = 0),
ext AS (SELECT c_custkey AS ord, c_name AS name, c_mktsegment AS city, 'https://x.com/' || (c_custkey // 2) || '/' AS url FROM customer WHERE c_custkey % 2 = 0), dis AS (SELECT c_custkey AS ord, c_name AS name, c_mktsegment AS city, 'https://x.com/' || (c_custkey // 4) AS url FROM customer),
ck AS (SELECT {_KEY_SQL.format("name", "city")} AS key, rtrim(url, '/') AS page FROM cur), l AS (SELECT *, 'extracted' AS origin, 1 AS prio FROM ext UNION ALL SELECT *, 'discovered', 2 FROM dis),
k AS (SELECT *, {_KEY_SQL.format("name", "city")} AS key, rtrim(url, '/') AS page FROM l),
r AS (SELECT * FROM k WHERE key NOT IN (SELECT key FROM ck) AND page NOT IN (SELECT page FROM ck) QUALIFY row_number() OVER (PARTITION BY page ORDER BY prio, ord) = 1)
SELECT name, url, 'curated' AS origin FROM cur UNION ALL SELECT name, url, origin FROM r"""
)
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"))
    at = lambda n, tail="": F.concat(F.lit("https://x.com/"), n.cast("bigint").cast("string"), F.lit(tail))
    curated = c.where("ord % 3 = 0").withColumn("url", at(F.col("ord")))
    extracted = c.where("ord % 2 = 0").withColumn("url", at(F.floor(F.col("ord") / 2), "/"))
    found = c.withColumn("url", at(F.floor(F.col("ord") / 4)))
    return discovery.catalogue(curated, extracted, found).select("name", "url", "origin")


@query(
    """WITH i AS (SELECT lower(s_name) AS n, 'https://www.s' || s_suppkey || '.com/x' AS site FROM supplier WHERE s_suppkey % 2 = 0), f AS (SELECT s_name AS n, 'http://shop' || (s_suppkey % 7) || '.org/a' AS u FROM supplier WHERE s_acctbal > 0)
SELECT DISTINCT coalesce(regexp_extract(site, 'www\\.([^/]*)', 1), regexp_extract(u, '//([^/]*)', 1)) AS host FROM f LEFT JOIN i ON lower(f.n) = i.n"""
)
def active_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = _read(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    inventory = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.lit("x").alias("city"), F.concat(F.lit("https://www.s"), key, F.lit(".com/x")).alias("website_url"), F.col("s_suppkey").alias("ord"))
    feed = s.select(F.col("s_name").alias("restaurant"), F.lit("X").alias("city"), F.concat(F.lit("http://shop"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".org/a")).alias("source_url"), F.when(F.col("s_acctbal") > 0, "active").otherwise("stale").alias("status"))
    return discovery.active_hosts(feed, inventory)


@query(f"WITH {OFFERS_SQL} SELECT *, count(*) OVER (PARTITION BY restaurant) AS same_name FROM (SELECT restaurant, city, count(*) AS deals FROM offers GROUP BY ALL)")
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _offers(spark, sf_dir).groupBy("restaurant", "city").agg(F.count("*").alias("deals"))
    return serve.name_counts(places)


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, coalesce(nullif(trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'restaurant') || '.png' AS filename FROM pages"""
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1))
    return _read(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.safe_filename(bare, F.lit("png")).alias("filename"))


@query(
    f"""WITH {_SNAP_SQL} SELECT id, epoch(TIMESTAMP '{NOW}') - floor(epoch(first_seen)) <= 7 * 86400 AS is_new, strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen FROM s"""
)
def new_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select("id", dates.is_new(F.col("first_seen").cast("timestamp"), _now()).alias("is_new"), dates.iso(F.col("last_seen")).alias("last_seen"))
