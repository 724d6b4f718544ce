"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources they belong
to. Tokens flow from patterns through sources to the sources' quotas; a pattern
offers its tokens once for each allowed copy, and every further copy costs more
than the one before. As all costs sit on the copies, the cheapest flow is found
layer by layer: a maximum flow with first copies only, which is then augmented
with second copies, and so on. The flow says how many tokens of each pattern go
where; documents are laid along that axis in a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernmill.llm.scratch import few, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
SEED = 7
#: Hexadecimal digits of the seeded hash that split a pattern's documents for the running sums.
SLICE_DIGITS = 3


def source_order(sources: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, none above ``most`` times its size.

    What a source cannot take is shared again by weight among the others until
    no target is above its bound. ``weights`` repeat over the ordered sources.
    """
    order = source_order(list(sizes))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    full: set[str | None] = set()
    while len(full) < len(order):
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > most * sizes[s]}
        if not over:
            break
        full |= over
    return {s: float(most * sizes[s]) if s in full else weight[s] * level for s in order}


class _Flow:
    """Maximum flow by blocking flows; edges may gain capacity between runs."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.augmented = 0

    def edge(self, a: int, b: int, room: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return
            at = [0] * len(self.out)
            while path := self._path(source, sink, level, at):
                moved = min(self.room[e] for e in path)
                self.augmented += 1
                for e in path:
                    self.room[e] -= moved
                    self.room[e ^ 1] += moved

    def _path(self, source: int, sink: int, level: dict[int, int], at: list[int]) -> list[int]:
        path: list[int] = []
        node = source
        while node != sink:
            while at[node] < len(self.out[node]):
                e = self.out[node][at[node]]
                if self.room[e] and level.get(self.to[e], -1) == level[node] + 1:
                    break
                at[node] += 1
            else:
                if not path:
                    return []
                node = self.to[path.pop() ^ 1]
                at[node] += 1
                continue
            path.append(e)
            node = self.to[e]
        return path


def route(patterns: dict[tuple[str | None, ...], int], quotas: dict[str | None, int], max_copies: int = MAX_COPIES, counted: list[int] | None = None) -> dict[tuple[str | None, ...], dict[str | None, int]]:
    """Tokens that each pattern gives each of its sources, fewest repeats first.

    No pattern gives more than ``max_copies`` times its tokens and no source gets
    more than its quota; the total is the largest possible. Every pattern goes
    through the flow, also one that is alone with its source. ``counted`` gathers
    the edges from patterns to sources and the paths that were augmented.
    """
    names, keys = list(quotas), list(patterns)
    place = {s: 1 + len(keys) + i for i, s in enumerate(names)}
    sink = 1 + len(keys) + len(names)
    flow = _Flow(sink + 1)
    offers = [flow.edge(0, 1 + i, 0) for i in range(len(keys))]
    ways = {(k, s): flow.edge(1 + i, place[s], max_copies * patterns[k]) for i, k in enumerate(keys) for s in k if s in place}
    for s in names:
        flow.edge(place[s], sink, quotas[s])
    for _ in range(max_copies):
        for e, k in zip(offers, keys, strict=True):
            flow.room[e] += patterns[k]
        flow.run(0, sink)
    if counted is not None:
        counted += [len(ways), flow.augmented]
    out: dict[tuple[str | None, ...], dict[str | None, int]] = {k: {} for k in keys}
    for (k, s), e in ways.items():
        if flow.room[e ^ 1]:
            out[k][s] = flow.room[e ^ 1]
    return out


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def mix(
    docs: DataFrame,
    members: str = "members",
    size: str = "size",
    key: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """``docs`` with a column ``copies`` and ``taken_by`` (a source for each copy), the sources' sizes and targets.

    ``members`` is an array of the sources a document belongs to, ``size`` its
    tokens. A copy is taken if its middle lies below its pattern's flow when the
    pattern's documents are laid out in the order of a seeded hash of ``key``, so
    a source misses its quota by half a document at most. The order depends on
    values only: reruns agree. A null in ``members`` is a source like others; a
    null or empty array belongs nowhere and gets no copies; a null size is 0.
    Rows alike in pattern, key and size get alike: where a copy ends among them,
    all get it. Other columns are kept,
    unless they bear one of the two new names; an empty table stays empty.

    The driver holds a row for each set of sources, never one for a document. What
    a pattern gives is a prefix of its order, so only ids and sizes are shuffled,
    to find where each copy ends; documents are compared with that in place.
    """
    spark = docs.sparkSession
    docs = docs.drop("copies", "taken_by")
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array().cast("array<string>"))))
    sums = docs.groupBy(pattern.alias("pattern")).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("n")).collect()
    patterns = {tuple(r["pattern"]): r["n"] for r in sums if r["pattern"]}
    sizes: dict[str | None, int] = {}
    for k, n in patterns.items():
        for s in k:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, share, max_copies)
    routed = route(patterns, {s: int(t + 0.5) for s, t in goal.items()}, max_copies)

    rows = []
    for k, given in routed.items():
        upto, ends = 0, []
        for s in k:
            if s in given:
                upto += given[s]
                ends.append((s, upto))
        rows.append((list(k), patterns[k], upto, ends))
    plan = spark.createDataFrame(rows, "_pattern array<string>, _total long, _flow long, _ends array<struct<s:string,upto:long>>")
    tokens = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    laid = docs.select(pattern.alias("p"), tokens.alias("n"), _digest(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    laid = laid.withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    before = Window.partitionBy("p").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16 ** SLICE_DIGITS rows for a pattern.
    starts = laid.groupBy("p", "slice").agg(F.sum("n").alias("sum")).select("p", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    starts = starts.join(few(plan), F.col("p") == F.col("_pattern"), "left").select(F.col("p").alias("p2"), F.col("slice").alias("slice2"), "start", "_total", "_flow", "_ends")
    within = Window.partitionBy("p", "slice").orderBy("h", "k", "n").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    laid = laid.join(starts, (F.col("p") == F.col("p2")) & (F.col("slice") == F.col("slice2")), "left")
    twice_middle = lambda k: 2 * ((k - 1) * F.col("_total") + F.col("start") + F.col("before")) + F.col("n")
    copies = F.filter(F.sequence(F.lit(1), F.lit(max_copies)), lambda k: (F.col("n") > 0) & (twice_middle(k) <= 2 * F.col("_flow")))
    by = F.transform(copies, lambda k: F.filter(F.col("_ends"), lambda e: twice_middle(k) <= 2 * e["upto"])[0]["s"])
    # The last document of each copy and source in the pattern's order.
    taken = laid.select("p", F.struct("h", "k", "n").alias("at"), F.posexplode(by).alias("c", "s"))
    ends = taken.groupBy("p", "c", "s").agg(F.max("at").alias("last")).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("c", "last", "s"))).alias("_fernmill_lasts"))
    ends = few(written(ends.select(F.col("p").alias("_fernmill_pattern"), "_fernmill_lasts"), "mix-ends"))
    own = F.struct(_digest(F.col(key), seed).alias("h"), F.col(key).alias("k"), tokens.alias("n"))
    upto = F.filter(F.col("_fernmill_lasts"), lambda e: (tokens > 0) & (own <= e["last"]))
    by = F.transform(F.array_distinct(F.transform(upto, lambda e: e["c"])), lambda c: F.filter(upto, lambda e: e["c"] == c)[0]["s"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.withColumn("_fernmill_members", pattern).join(ends, F.col("_fernmill_members") == F.col("_fernmill_pattern"), "left")
    by = F.coalesce(by, F.array().cast("array<string>"))
    return out.select(*names, F.size(by).alias("copies"), by.alias("taken_by")), sizes, goal


def by_source(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken) for documents of one source each.

    Size is the number of words of the whole text (null: none). The sizes are
    written to the shared folder first, so texts are read once.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    light = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"))
    light = written(light, "sizes").withColumn("members", F.array("source"))
    mixed, sizes, goal = mix(light, **options)
    of = docs.sparkSession.createDataFrame([(s, sizes[s], round(goal[s], 6)) for s in sizes], "_s string, source_size long, target double")
    out = mixed.join(few(of), F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: The registered query in DuckDB's SQL; with one source to a document the flow is each source's own.
SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, {SHARE} * sum(source_size) OVER () AS total, 2.0 * source_size / weight AS ratio FROM w),
l AS (SELECT *, ((total - 2 * coalesce(sum(source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level FROM o),
f AS (SELECT min(level) FILTER (WHERE weight * level <= 2 * source_size) AS level, min(ratio) FILTER (WHERE weight * level <= 2 * source_size) AS first FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio >= first THEN weight * (SELECT arg_min(level, ratio) FROM l WHERE weight * level <= 2 * source_size) ELSE 2.0 * source_size END AS target FROM l, f),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
c AS (SELECT doc_id, p.source, size, source_size, round(target, 6) AS target,
    CASE WHEN size = 0 THEN 0 ELSE (2 * before + size <= 2 * floor(target + 0.5))::BIGINT + (2 * (source_size + before) + size <= 2 * floor(target + 0.5))::BIGINT END AS copies
    FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, copies::INTEGER AS copies, (copies * size)::BIGINT AS taken FROM c
"""
