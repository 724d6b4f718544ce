"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Everything here is DataFrame expressions. The fixed patterns' matches are the
seed entities. The one or two words before and behind a known entity make
lexical patterns. Patterns and all that they introduce form a graph, in which
both are scored in turns; what confident patterns introduce is found, found
entities induce patterns of their own, and so on until nothing changes.

Patterns with possessive loops and look-behinds match what the plain ones match;
they only keep long runs from being tried again at every character.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmill.llm.quality import let
from fernmill.llm.scratch import few, written

# The base patterns, in the order of kinds.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words as contexts and candidates see them: one ends behind ``:`` and ``=``, and groups of digits with a
#: space or dash between go together. And what may stand around one.
WORD = r"[0-9]++(?:[\x20-][0-9]++)++|[^\x20\x09-\x0D:=]*+[:=]++|[^\x20\x09-\x0D:=]++"
OPENING, CLOSING = "([{<\"'“‘«", ".,;!?)]}>\"'”’»:="
KINDS = ["email", "ip", "card", "phone", "found"]

#: Distinct known instances that a pattern must introduce.
MIN_SUPPORT = 5
#: Share of a pattern's occurrences that must be known instances for all its instances to be counted.
MIN_KNOWN = 0.2
#: Share of its occurrences that a pattern introduces of an instance that counts in full; common words have less.
LED = 0.2
#: Confidence of a pattern that may discover, and score of a discovered instance, at least.
MIN_CONFIDENCE = 0.6
#: Turns of scoring the graph, and rounds of bootstrapping, past which learning fails.
TURNS, MAX_ROUNDS = 3, 50

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def running(lengths: Column) -> Column:
    """Sums of what stands before each element, by chunks so that no step copies a long array."""
    chunk = 256

    def sums(a: Column) -> Column:
        return F.slice(F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 1, F.size(a))

    def chunked(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda c: F.slice(a, c * chunk + 1, F.lit(chunk)))
        totals = lambda p: sums(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, totals(p), lambda x, t: F.transform(sums(x), lambda s: s + t))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).when(F.size(lengths) <= chunk, sums(lengths)).otherwise(chunked(lengths))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost, non-overlapping matches of a pattern with their places in code points.

    The text between matches comes from a split by the same pattern, so the two
    arrays interleave and their lengths give the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(m: Column) -> Column:
        steps = F.zip_with(m, F.slice(between, F.lit(2), F.size(m)), lambda x, y: F.length(x) + F.length(y))
        starts = lambda: running(steps)
        first = lambda: F.length(between[0])
        span = lambda x, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(x)).alias("end"), x.alias("value"))
        return let(first(), lambda f: F.zip_with(m, starts(), lambda x, s: span(x, s + f)))

    return let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(F.array().cast(SPAN)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def _luhn(x: Column) -> Column:
    def checks(d: Column) -> Column:
        digit = lambda i: F.substring(d, F.length(d) + 1 - i, F.lit(1)).cast("int")
        doubled = lambda n: F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i))) % 10 == 0

    return let(_digits(x), lambda d: F.when(F.length(d).between(16, 19), checks(d)).otherwise(F.lit(False)))


def _phone(x: Column) -> Column:
    return F.length(_digits(x)).between(8, 15)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by kind, then start; matches that fail their check are dropped.

    Each pattern runs only where a plain test finds what any match contains.
    """
    none = F.array().cast(SPAN)
    email = F.when(text.contains("@"), matches(text, EMAIL, "email")).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP, "ip"), lambda s: _octets(s["value"]))).otherwise(none)
    card = F.when(text.rlike(r"[0-9][0-9\x20-]{14,}[0-9]"), F.filter(matches(text, CARD, "card"), lambda s: _luhn(s["value"]))).otherwise(none)
    phone = F.when(text.rlike(r"\+[0-9]"), F.filter(matches(text, PHONE, "phone"), lambda s: _phone(s["value"]))).otherwise(none)
    return F.concat(email, ip, card, phone)


def stream(text: Column, seeded: bool = False) -> Column:
    """The words of a text in order with its base spans among them, as (start, end, seed, word, value).

    A seed's word is null, so that no context reaches over it; words that meet a
    seed are left out. ``value`` is what may be an instance: a word without the
    brackets, quotes and stops around it. A text without seeds has no stream if ``seeded``.
    """
    free = lambda w, b: ~F.exists(b, lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"]))
    named = lambda start, value, seed, word: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), seed.alias("seed"), word.alias("word"), value.alias("value"))
    bare = lambda w: let(F.ltrim(w["value"], F.lit(OPENING)), lambda v: named(w["start"] + F.length(w["value"]) - F.length(v), F.rtrim(v, F.lit(CLOSING)), F.lit(False), F.lower(w["value"])))
    seeds = lambda b: F.transform(b, lambda x: named(x["start"], x["value"], F.lit(True), F.lit(None).cast("string")))
    every = lambda b: F.sort_array(F.concat(seeds(b), F.transform(F.filter(matches(text, WORD, "word"), lambda w: free(w, b)), bare)))
    return let(base_spans(text), lambda b: F.when(F.size(b) > 0, every(b)) if seeded else every(b))


def _around(w: Column, i: Column) -> Column:
    """The patterns of the place ``i`` (from 0) in an array of words: one or two words before it, one or two behind it."""
    at = lambda k: F.get(w, i + k)
    pair = lambda side, x, y: F.concat(F.lit(side), x, F.lit(" "), y)  # noqa: E731  null if a word is missing
    return F.array(F.concat(F.lit("<"), at(-1)), pair("<", at(-2), at(-1)), F.concat(F.lit(">"), at(1)), pair(">", at(1), at(2)))


def _occurrences(docs: DataFrame, text: str, seeds: bool = False) -> DataFrame:
    """(instance, seed, pattern) for every element of the documents' streams and every pattern around it; for seeds only if wanted."""
    rows = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    if seeds:  # any base span has one of these
        rows = rows.where(F.col("text").rlike("[0-9@]"))
    place = lambda x, w, i: F.struct(F.lower(x["value"]).alias("instance"), x["seed"].alias("seed"), _around(w, i).alias("patterns"))
    wanted = (lambda x: x["seed"]) if seeds else (lambda x: x["value"] != "")
    placed = lambda s: let(F.transform(s, lambda x: x["word"]), lambda w: F.filter(F.transform(s, lambda x, i: F.when(wanted(x), place(x, w, i))), lambda x: x.isNotNull()))
    rows = rows.select(F.explode(let(stream(F.col("text"), seeds), placed)).alias("s"))
    return rows.select("s.instance", "s.seed", F.explode("s.patterns").alias("pattern"))


def _totals(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each pattern stand in the corpus."""
    rest = F.substring("pattern", F.lit(2), F.length("pattern"))
    named = written(patterns.select("pattern", rest.alias("words"), F.regexp_extract("pattern", r"^.([0-9]++(?:[\x20-][0-9]++)++|[^ ]*)", 1).alias("first")), "pii-named")
    body = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    # Each word with the next; only those that open some pattern go on.
    pairs = docs.select(body.alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("w"), F.slice("w", F.lit(2), F.size("w")).alias("v"))).alias("p"))
    pairs = pairs.select(F.col("p.w").alias("first"), F.col("p.v").alias("next")).join(few(named.select("first").distinct()), "first")
    seen = pairs.select(F.explode(F.array(F.col("first"), F.concat("first", F.lit(" "), "next"))).alias("words")).join(few(named.select("words").distinct()), "words")
    counted = written(seen.groupBy("words").agg(F.count("*").alias("total")), "pii-counted")
    return named.join(few(counted), "words").select("pattern", "total")


@dataclass
class Patterns:
    """What was learned: patterns (pattern, confidence), and instances (instance, score) to be found; ``any`` is false if there is none."""

    patterns: DataFrame | None
    instances: DataFrame | None
    any: bool


def _confidences(graph: DataFrame, shares: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) and (instance, score) of the pattern-instance graph, scored in turns.

    A known instance (``seed``) has the score 1. A pattern's confidence is the mean score of the distinct
    instances it introduces, where one that is not known counts by what
    patterns of *other* families say of it, so no pattern vouches for itself. An
    instance's score is 1 - prod(1 - confidence) over the best pattern of each
    family around it, times its ``share``: less
    than 1 if hardly any of its occurrences follow a pattern, as of a common word.
    """
    if shares is None:
        graph = graph.withColumn("share", F.lit(1.0))
    else:
        graph = graph.join(few(shares), "instance", "left").withColumn("share", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("share", F.lit(0.0))))
    graph = written(graph.withColumn("family", _family(F.col("pattern"))), "pii-graph")
    confidence = graph.groupBy("pattern").agg(F.avg(F.col("seed").cast("double")).alias("confidence"))
    for _ in range(TURNS):
        confidence = written(confidence, "pii-confidence")
        told = written(graph.join(few(confidence), "pattern").withColumn("miss", F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))), "pii-told")
        families = written(told.where("not seed").groupBy("instance", "family").agg(F.min("miss").alias("said"), F.max("share").alias("share")), "pii-families")
        scores = families.groupBy("instance").agg(F.sum("said").alias("all"), F.max("share").alias("share"))
        weighed = told.drop("share").join(families, ["instance", "family"], "left").join(scores.select("instance", "all"), "instance", "left")
        score = F.when(F.col("seed"), 1.0).otherwise((1 - F.exp(F.col("all") - F.col("said"))) * F.col("share"))
        confidence = weighed.groupBy("pattern").agg(F.avg(score).alias("confidence"))
    return written(confidence, "pii-confidence"), written(scores.select("instance", ((1 - F.exp("all")) * F.col("share")).alias("score")), "pii-scores")


def _family(pattern: Column) -> Column:
    """Side and nearest word of a pattern: patterns that agree in them see one place, and are one witness."""
    side, rest = F.substring(pattern, 1, 1), F.substring(pattern, F.lit(2), F.length(pattern))
    return F.concat(side, F.when(side == "<", F.substring_index(rest, " ", -1)).otherwise(F.substring_index(rest, " ", 1)))


def learn(docs: DataFrame, text: str = "text", min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_known: float = MIN_KNOWN, led: float = LED, max_rounds: int = MAX_ROUNDS) -> Patterns:
    """Bootstrap patterns and instances from the seeds until a round adds no pattern.

    Each round takes the patterns around known instances (first the seeds, later
    what was found) that at least ``min_support`` distinct ones induce and whose
    occurrences are known instances by ``min_known`` or more, counts all that the
    corpus has in their places, and scores the whole graph again
    (:func:`_confidences`). What patterns of ``min_confidence`` introduce and
    scores as much is found. All counts cover all documents; null texts have
    none. Running past ``max_rounds`` raises, as results would depend on it.
    """
    induced = written(_occurrences(docs, text, seeds=True).where("pattern is not null").groupBy("pattern", "instance").agg(F.count("*").alias("n")), "pii-induced")
    measured, graph, found, confidence = None, None, None, None
    for _ in range(max_rounds):
        asked = induced.groupBy("pattern").agg(F.count("*").alias("support"), F.sum("n").alias("n")).where(F.col("support") >= min_support)
        if measured is not None:
            asked = asked.join(measured, "pattern", "left_anti")
        asked = written(asked, "pii-asked")
        if asked.isEmpty():
            break
        measured = asked.select("pattern") if measured is None else written(measured.unionAll(asked.select("pattern")), "pii-measured")
        fit = asked.join(few(written(_totals(docs, text, asked), "pii-totals")), "pattern", "left")
        fit = written(fit.where(F.col("n") >= min_known * F.coalesce("total", "n")).select("pattern"), "pii-fit")
        if fit.isEmpty():
            break
        more = _occurrences(docs, text).join(few(fit), "pattern").groupBy("pattern", "instance", "seed").agg(F.count("*").alias("n"))
        if found is not None:  # what was found is known from now on
            more = written((graph.unionAll(more)).join(few(found.select("instance", F.lit(True).alias("known"))), "instance", "left"), "pii-more")
            more = more.select("pattern", "instance", F.coalesce(F.col("known"), F.col("seed")).alias("seed"), "n")
        graph = written(more, "pii-graph")
        scored = _confidences(graph, None)
        sure = graph.where("not seed").join(few(scored[0].where(F.col("confidence") >= min_confidence)), "pattern")
        maybe = sure.groupBy("instance").agg(F.max("n").alias("led")).join(few(scored[1].where(F.col("score") >= min_confidence).select("instance")), "instance")
        maybe = written(maybe, "pii-maybe")
        if maybe.isEmpty():
            break
        seen = _occurrences(docs, text).where("not seed").select("instance", F.coalesce("pattern", F.lit("")).alias("pattern")).join(few(maybe.select("instance")), "instance")
        seen = written(seen.groupBy("instance", "pattern").agg(F.count("*").alias("n")), "pii-seen")
        # Each place gives four patterns, those that reach over an end an empty one.
        often = seen.groupBy("instance").agg((F.sum("n") / 4).alias("total"))
        shares = written(maybe.join(often, "instance").select("instance", F.least(F.lit(1.0), F.col("led") / (led * F.col("total"))).alias("share")), "pii-shares")
        scored = _confidences(graph, shares)
        confidence = scored[0]
        fresh = scored[1].where(F.col("score") >= min_confidence)
        found = written(fresh if found is None else found.unionAll(fresh), "pii-found")
        fresh = seen.where("pattern <> ''").join(few(found.select("instance")), "instance").select("pattern", "instance", "n")
        induced = written(induced.join(fresh.select("pattern", "instance"), ["pattern", "instance"], "left_anti").unionByName(fresh), "pii-induced")
    else:
        raise RuntimeError(f"patterns did not settle in {max_rounds} rounds")
    if found is None:
        return Patterns(None, None, False)
    return Patterns(confidence.where(F.col("confidence") >= min_confidence), found, not found.isEmpty())


def _discovered(docs: DataFrame, text: str, patterns: Patterns) -> DataFrame:
    """(key, added): the spans of found instances, once for each text that has some."""
    rows = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = rows.select(text_key(F.col("text")).alias("key"), F.explode(F.filter(stream(F.col("text")), lambda x: ~x["seed"])).alias("s"))
    rows = rows.select("key", "s", F.lower("s.value").alias("instance")).join(few(patterns.instances.select("instance")), "instance")
    span = F.struct(F.lit("found").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
    return rows.groupBy("key").agg(F.array_sort(F.collect_set(span)).alias("added"))


def text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def by_kind(spans: Column) -> Column:
    """Spans in the order of kinds, then starts."""
    ranked = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text", patterns: Patterns | None = None) -> DataFrame:
    """``docs`` with the arrays ``base`` and ``spans`` of (kind, start, end, value).

    Offsets count code points, ends are exclusive. ``base`` holds the fixed
    patterns' spans, ``spans`` these and the discovered ones, both by kind and
    start. A null text counts as empty and stays null. Other columns are kept
    unless they bear one of the two names; repeated rows stay; an empty table
    stays empty.
    """
    docs = docs.drop("base", "spans")
    patterns = patterns or learn(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("base", base_spans(body))
    if not patterns.any:
        return out.withColumn("spans", F.col("base"))
    # Texts that repeat make hot keys; a list of spans that is too long to broadcast leaves these to adaptive skew joins.
    key = "_fernmill_text_key"
    added = _discovered(docs, text, patterns).withColumnRenamed("key", key).withColumnRenamed("added", "_fernmill_added")
    out = out.withColumn(key, text_key(body)).join(few(written(added, "pii-added")), key, "left")
    return out.withColumn("spans", by_kind(F.concat("base", F.coalesce("_fernmill_added", F.array().cast(SPAN))))).drop(key, "_fernmill_added")


def masked(text: Column, spans: Column) -> Column:
    """A text with every span replaced by its kind in brackets; spans that overlap go as one, under the first's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    piece = lambda a, s: F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], -s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct((-s["end"]).alias("at"), piece(a, s).alias("out")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    joined = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def mask(docs: DataFrame, text: str = "text", patterns: Patterns | None = None) -> DataFrame:
    """``docs`` with all personal data masked in ``text``; other columns and clean texts stay as they are."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("body"))
    found = find(rows, "body", patterns or learn(rows, "body"))
    return found.select(*(masked(F.col("body"), F.col("spans")).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
