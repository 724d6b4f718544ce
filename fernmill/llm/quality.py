"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: punctuation, navigation, symbols, shouting and
boilerplate. Lines that fail are removed, and a document that loses too much of
its words, or fails the base rules, is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document is rejected if its failing lines hold more than this share of its words.
MAX_LOST = 0.4
MIN_WORDS = 50
MAX_REPEATED = 50

# Patterns of the line rules. They mean the same to Java and RE2.
WHITE = r"\x20\x09-\x0D"
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|»›•·]"
ENDED = rf"""[.!?…。:;,)"'”’»][{WHITE}]*\z"""
STOP = r"[.!?…。]"
SHOUT = r"!!"
BOILERPLATE = r"(?i)(all rights reserved|cookie|javascript|privacy policy|terms of (use|service)|subscribe|click here|log in|sign up|copyright|powered by)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+"))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words is navigation, symbols, shouting, boilerplate or lacks punctuation."""
    navigation = (count(line, SEPARATOR) >= 2) & (4 * count(line, SEPARATOR) >= n)
    symbols = (count(line, SYMBOL) >= 3) & (4 * count(line, SYMBOL) >= n)
    shouting = 4 * count(line, SHOUT) >= n
    boilerplate = (n <= 30) & line.rlike(BOILERPLATE)
    unpunctuated = ~line.rlike(ENDED) & ((n <= 3) | ((n > 40) & ~line.rlike(STOP)))
    return navigation | symbols | shouting | boilerplate | unpunctuated


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of three found twice or more in ``words``."""

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("w"), i.alias("i")))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # Most texts repeat no window. Sorting hashes, an array of longs, is enough to see that.
    hashes = lambda w: F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))
    repeats = lambda w: F.size(F.array_distinct(hashes(w))) < F.size(w) - 2
    return F.when(F.size(words) < 4, F.lit(0)).when(repeats(words), exact(words)).otherwise(F.lit(0))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Rows (doc_id, text, the base measures, n_lost_words, base_failed, kept), one for each row of ``docs``.

    n_words, word_chars (code points), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line) and n_repeat_words (words in windows of three
    found twice or more) are longs. base_failed: under 50 words, or over half of
    them repeated. kept: not base_failed, and failing lines hold at most
    ``max_lost`` of the words. A null text has no words and fails; ids may be
    null or repeat; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    by_words = let(
        words_of(body),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    lines = lambda: F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    lost = lambda x: let(count_words(x), lambda n: F.when(line_fails(x, n), n).otherwise(F.lit(0)))
    by_lines = let(
        lines(),
        lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + lost(b)).alias("n_lost_words")),
    )
    out = rows.withColumn("w", by_words).withColumn("l", by_lines).withColumn("n_symbols", count(body, SYMBOL).cast("long"))
    out = out.select("doc_id", "text", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lost_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= F.lit(round(100 * max_lost)) * F.col("n_words")))


def cleaned(text: Column) -> Column:
    """A text without its failing lines; lines without a word stay as they are."""
    keep = lambda x: let(count_words(x), lambda n: (n == 0) | ~line_fails(x, n))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Kept documents only, as (doc_id, text) without their failing lines."""
    return measure(docs, doc_id, text, max_lost).where("kept").select("doc_id", cleaned(F.col("text")).alias("text"))


_SQL_WORDS = rf"regexp_extract_all({{0}}, '[^{WHITE}]+')"


def _sql_count(x: str, pattern: str) -> str:
    return "len(regexp_extract_all({}, '{}'))".format(x, pattern.replace("'", "''"))


#: The registered query in DuckDB's SQL.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, {_SQL_WORDS.format("text")} AS w FROM d),
spots AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM spots),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams),
covered AS (SELECT DISTINCT rid, i + s.k AS i FROM twice, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1),
repeated AS (SELECT rid, count(*) AS n_repeat_words FROM covered GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT rid, line, {_sql_count("line", f"[^{WHITE}]+")} AS n FROM lines WHERE regexp_matches(line, '[^{WHITE}]')),
judged AS (SELECT rid, line, n,
    ({_sql_count("line", SEPARATOR)} >= 2 AND 4 * {_sql_count("line", SEPARATOR)} >= n)
    OR ({_sql_count("line", SYMBOL)} >= 3 AND 4 * {_sql_count("line", SYMBOL)} >= n)
    OR 4 * {_sql_count("line", SHOUT)} >= n
    OR (n <= 30 AND regexp_matches(line, '{BOILERPLATE}'))
    OR (NOT regexp_matches(line, '{ENDED.replace("'", "''")}') AND (n <= 3 OR (n > 40 AND NOT regexp_matches(line, '{STOP}')))) AS fails FROM worded),
by_line AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS n_lost_words FROM judged GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_sql_count("text", SYMBOL)} AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words
    FROM w LEFT JOIN by_line USING (rid) LEFT JOIN repeated USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, n_lost_words::BIGINT AS n_lost_words, base_failed, NOT base_failed AND 100 * n_lost_words <= {round(100 * MAX_LOST)} * n_words AS kept
FROM f
"""
