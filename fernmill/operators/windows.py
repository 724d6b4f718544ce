"""Windows over the lines of documents: context around signals, and offer candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernmill.functions import dates, fixed
from fernmill.functions import text as T

#: Lines kept before and after a signal, and characters of a whole context.
BEFORE, AFTER, CONTEXT_CHARS = 5, 8, 30_000
#: Lines that may explain an offer: before it and after it.
LEAD, TRAIL = 3, 5


def is_signal(line: Column) -> Column:
    return T.matches(line, fixed.PROMO_SIGNAL) | T.matches(line, fixed.VALUE_SIGNAL)


def lines_in_context(lines: DataFrame, key: str, signal: Column, pos: str = "pos", before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Rows of ``lines`` within ``before`` rows ahead of a signal or ``after`` behind it, numbered from 1.

    A window over each document's lines, so one shuffle on ``key``.
    """
    near = Window.partitionBy(key).orderBy(pos).rowsBetween(-after, before)
    kept = lines.withColumn("_near", F.max(signal.cast("int")).over(near)).where("_near = 1").drop("_near")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(pos)))


def context_of(lines: Column, before: int = BEFORE, after: int = AFTER, most: int = CONTEXT_CHARS) -> Column:
    """The numbered context of an array of lines as one text; no shuffle, for arrays at hand."""
    usable = F.filter(lines, lambda x: F.length(x).between(2, 500))

    def render(own: Column) -> Column:
        signals = F.transform(F.filter(F.transform(own, lambda x, i: F.when(is_signal(x), i)), lambda i: i.isNotNull()), lambda i: i)
        keep = lambda s: F.filter(F.transform(own, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.exists(s, lambda k: (p["i"] >= k - before) & (p["i"] <= k + after)))
        kept = T.let(signals, keep)
        return F.substring(F.array_join(F.transform(kept, lambda p, n: F.concat((n + 1).cast("string"), F.lit(". "), p["x"])), "\n"), 1, most)

    return T.let(usable, render)


def _marked(line: Column) -> Column:
    """A line as it is compared, and what the rules of details ask of it."""

    def marks(x: Column) -> Column:
        explains = (F.length(x) <= 140) & (T.matches(x, fixed.VALIDITY_CONTEXT) | T.matches(x, fixed.PROMO_CONTEXT) | (F.size(F.split(x, " ")) <= 10))
        return F.struct(x.alias("x"), T.is_noise(x).alias("noise"), explains.alias("explains"), T.starts_offer(x).alias("starts"))

    return T.let(T.normalize_line(line), marks)


def _details(summary: Column, around: Column) -> Column:
    """Of marked lines around an offer's, those that explain it."""
    lines = F.filter(around, lambda m: (m["x"] != summary) & ~m["noise"])
    start = F.struct(F.array().cast(T.STRINGS).alias("found"), F.lit(False).alias("done"))

    def step(a: Column, m: Column) -> Column:
        stops = m["starts"] & (F.size(a["found"]) > 0)
        added = F.when(m["explains"], F.concat(a["found"], F.array(m["x"]))).otherwise(a["found"])
        return F.when(a["done"], a).when(stops, F.struct(a["found"].alias("found"), F.lit(True).alias("done"))).otherwise(F.struct(added.alias("found"), F.lit(False).alias("done")))

    return F.aggregate(lines, start, step, lambda a: a["found"])


def details_of(summary: Column, around: Column) -> Column:
    """Of the lines around an offer's, those that explain it, up to where another offer begins."""
    return _details(summary, F.transform(around, _marked))


def candidates(lines: DataFrame, key: str, line: str = "line", pos: str = "pos") -> DataFrame:
    """Offer candidates (key, pos, text, summary, details, tags): each line with the lines that explain it.

    A candidate needs a tag and the marks of quality; of those with the same
    words in a document the first stays.
    """
    order = Window.partitionBy(key).orderBy(pos)
    # Each line is read once, and its neighbours take what was found: a frame of marks, not of texts.
    rows = lines.withColumn("_mark", _marked(F.col(line)))
    around = F.concat(F.collect_list("_mark").over(order.rowsBetween(-LEAD, -1)), F.collect_list("_mark").over(order.rowsBetween(1, TRAIL)))
    rows = rows.withColumn("_around", around).withColumn("summary", F.substring("_mark.x", 1, 180)).where(F.length("summary") >= 4)
    rows = rows.withColumn("_details", _details(F.col("summary"), F.col("_around")))
    rows = rows.withColumn("text", T.normalize_line(F.concat_ws(" ", "summary", "_details"))).withColumn("tags", T.detect_tags(F.col("text")))
    good = (F.size("tags") > 0) & T.is_quality_candidate(F.col("text"), F.col("summary"), F.col("tags"), dates.extract_days(F.col("summary")))
    rows = rows.where(good).withColumn("_n", F.row_number().over(Window.partitionBy(key, T.word_key(F.col("text"))).orderBy(pos)))
    return rows.where("_n = 1").select(key, pos, "text", "summary", T.dedupe_lines(F.col("_details")).alias("details"), "tags")
