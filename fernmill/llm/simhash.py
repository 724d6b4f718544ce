"""SimHash near-duplicates by vantage-point trees.

The 64 bits are cut into three parts. Two fingerprints within 4 bits differ by
at most one bit in some part, so a tree for each part, searched at a radius of
one bit, misses no pair. A tree's vantage points are fingerprints of the data
and its balls are cut where they halve them: the inside holds what lies within
the threshold, the outside the rest, and the ring of one bit beyond the
threshold, which the triangle inequality cannot rule out, goes to both sides.
So all pairs of a radius meet in at least one shard. The upper levels are grown
on a bounded sample and deal all fingerprints out to tasks; each task goes on
with trees over its own members until shards are small, and compares these
exactly over all 64 bits. A single tree over all bits would have to search a
ring of four bits, in which half of all distances fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmill.llm import minhash
from fernmill.llm.graph import components, hot_join, spanning, streamed_groups
from fernmill.llm.scratch import few, written
from fernmill.llm.shingles import shingles

SHINGLE = 4
MAX_DISTANCE = 4
#: Words of a shingle and similarity of near copies.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Parts of the bits with a tree each.
PARTS = 3
#: Fingerprints that the upper levels of the trees are grown on; all are placed in them.
SAMPLE = 1 << 16
#: Fingerprints a shard of the upper levels should hold, and sample members it needs for a cut.
SHARD, MIN_SAMPLE = 8192, 32
#: Fingerprints of one shard that a task holds once or twice; a larger shard is dealt out in pairs of blocks.
BLOCK = 1 << 18
#: Fingerprints that are compared all with all at the end.
LEAF = 256
#: Vantage points tried for a cut, and the share of a shard that its larger side may have.
TRIES, UNEVEN = 4, 0.9
SEED = 42


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text: the majority bits of its :func:`shingles`; without words (or null) 0."""
    return majority(shingles(text, shingle))


def majority(hashes: list[int]) -> int:
    """The bits that over half of the hashes have; 0 without hashes."""
    if not hashes:
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Column form of :func:`simhash` as a signed long; null texts count as empty."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="uint64").astype("int64")

    return udf(text)


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(parts: int = PARTS) -> list[np.uint64]:
    """Bit masks that cut 64 bits into parts."""
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    return [np.uint64(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(edges, edges[1:])]


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def cut(members: np.ndarray, mask: np.uint64, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point of ``members`` and the threshold that halves them best; None if none does.

    The inside is what lies within threshold + radius bits, the outside what lies
    beyond the threshold, so every pair within ``radius`` shares a side.
    """
    for _ in range(TRIES):
        point = members[rng.integers(len(members))]
        upto = np.cumsum(np.bincount(np.bitwise_count((members ^ point) & mask), minlength=65))
        inside = upto[np.minimum(np.arange(65) + radius, 64)]
        larger = np.maximum(inside, len(members) - upto)
        best = int(larger.argmin())
        if larger[best] <= UNEVEN * len(members):
            return point, best
    return None


@dataclass
class Tree:
    """The upper levels of one part's tree: a ball, or a leaf with its number and its blocks."""

    point: np.uint64 = np.uint64(0)
    threshold: int = 0
    inside: Tree | None = None
    outside: Tree | None = None
    leaf: int = -1
    blocks: int = 1


def grow(sample: np.ndarray, share: float, mask: np.uint64, radius: int, rng: np.random.Generator, leaves: list[int], shard: int = SHARD, block: int = BLOCK) -> Tree:
    """A tree over a sample, each of whose members stands for ``share`` fingerprints."""
    held = len(sample) * share
    found = cut(sample, mask, radius, rng) if held > shard and len(sample) >= MIN_SAMPLE else None
    if found is None:
        leaves.append(len(leaves))
        return Tree(leaf=leaves[-1], blocks=max(1, int(-(-held // block))))
    far = np.bitwise_count((sample ^ found[0]) & mask)
    sides = [grow(sample[x], share, mask, radius, rng, leaves, shard, block) for x in (far <= found[1] + radius, far > found[1])]
    return Tree(*found, *sides)


def shards(fps: np.ndarray, tree: Tree, mask: np.uint64, radius: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """The leaves that fingerprints fall into, those near a ball's surface into both sides."""
    if tree.leaf >= 0:
        yield tree, fps
        return
    far = np.bitwise_count((fps ^ tree.point) & mask)
    for side, own in ((tree.inside, far <= tree.threshold + radius), (tree.outside, far > tree.threshold)):
        if own.any():
            yield from shards(fps[own], side, mask, radius)


def _dealt(trees: list[tuple[np.uint64, Tree]], radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, members = [], []
            for k, (mask, tree) in enumerate(trees):
                for leaf, own in shards(fps, tree, mask, radius):
                    # A pair of blocks (i, j) is named by i * blocks + j.
                    block = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % leaf.blocks
                    for other in range(leaf.blocks):
                        keys.append((k << 56) + (leaf.leaf << 32) + np.minimum(block, other) * leaf.blocks + np.maximum(block, other))
                        members.append(own)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(members).view(np.int64))], names=["key", "fp"])

    return run


def close_pairs(members: np.ndarray, mask: np.uint64, radius: int, max_distance: int, counted: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all distinct members within ``max_distance`` that differ by at most ``radius`` within ``mask``.

    The tree goes on over the members of a shard. What no ball of the part
    divides is divided over all bits, and what no ball divides then is a dense
    group, which is searched from member to member. ``counted`` gathers the
    comparisons of small shards.
    """
    rng, open_ = np.random.default_rng(SEED), [(members, mask, radius)]
    while open_:
        own, mask, radius = open_.pop()
        if len(own) <= LEAF:
            if counted is not None:
                counted.append(len(own) * (len(own) - 1) // 2)
            near = np.bitwise_count(own[:, None] ^ own[None, :]) <= max_distance
            np.fill_diagonal(near, False)
            if near.any():
                i, j = spanning(near)
                yield own[i], own[j]
        elif found := cut(own, mask, radius, rng):
            far = np.bitwise_count((own ^ found[0]) & mask)
            open_ += [(own[far <= found[1] + radius], mask, radius), (own[far > found[1]], mask, radius)]
        elif mask != ALL:
            open_.append((own, ALL, max_distance))
        else:
            yield from zip(*_links_within(own, max_distance), strict=True)


def _links_within(members: np.ndarray, max_distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints: the searched tree's edges.

    Fingerprints are visited in rings around a vantage point (their distance to
    the first one); only rings within ``max_distance`` can hold a neighbour.
    """
    ring = np.bitwise_count(members ^ members[0])
    order = np.argsort(ring, kind="stable")
    left, ring = members[order], ring[order]
    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []
    while len(left) > 1:
        queue, left, ring = [(left[0], int(ring[0]))], left[1:], ring[1:]
        while queue and len(left):
            x, r = queue.pop()
            lo, hi = np.searchsorted(ring, r - max_distance, "left"), np.searchsorted(ring, r + max_distance, "right")
            near = np.bitwise_count(left[lo:hi] ^ x) <= max_distance
            if near.any():
                found, rings_found = left[lo:hi][near], ring[lo:hi][near]
                src.append(np.full(len(found), x, np.uint64))
                dst.append(found)
                queue += zip(found, rings_found.tolist(), strict=True)
                stay = np.ones(len(left), bool)
                stay[lo:hi] = ~near
                left, ring = left[stay], ring[stay]
    return src, dst


def _link_batches(radius: int, max_distance: int):
    cuts = masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed_groups(batches):
            mask = cuts[group.column(0)[0].as_py() >> 56]
            members = np.unique(group.column(1).to_numpy().view(np.uint64))
            found = list(close_pairs(members, mask, radius, max_distance))
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within ``max_distance``, transitively.

    ``fps`` has a column ``fp`` of distinct longs. Within a shard only spanning
    forests of the links are returned, so a dense group of n costs about n rows.
    The trees deepen with the table: shards of about ``shard`` members are dealt to
    tasks as far as a sample of ``sample`` can tell them apart, and one expected
    to hold more than ``block`` goes out as pairs of blocks, so that a task's
    memory stays bounded. Neither changes what is found. The sample is those of
    the smallest seeded hash.
    """
    total = fps.count()
    some = fps.orderBy(F.xxhash64(F.lit(SEED), "fp"), "fp").limit(sample)
    known = np.sort(np.array([r["fp"] for r in some.collect()], np.int64).view(np.uint64))
    radius, rng = max_distance // PARTS, np.random.default_rng(SEED)
    trees = [(mask, grow(known, total / max(1, len(known)), mask, radius, rng, [], shard, block)) for mask in masks()]
    dealt = fps.select("fp").mapInArrow(_dealt(trees, radius), "key long, fp long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_link_batches(radius, max_distance), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Rows (doc_id, fp, component_id, copies): the near-duplicate class of every row of ``docs``.

    Documents link where their fingerprints differ in at most ``max_distance``
    bits; component_id is the smallest doc_id reachable over links, itself
    included, and copies the number of rows of its class. Texts that are null or
    without words have the fingerprint zero and link like any other. Repeated
    rows come back as often as they went in; a null doc_id has a class but never
    names one (the class is null if all its ids are). Other columns are ignored.
    An empty table gives no rows.
    """
    marked = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "fingerprints")
    reps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
    roots = components(links(reps.select("fp"), max_distance))
    rooted = written(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    classes = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("copies"), F.count("*").alias("members"))
    total = marked.count()
    named = hot_join(rooted.select("fp", "root", "n"), classes, "root", "members", total).select("fp", "component_id", "copies", "n")
    return hot_join(marked, named, "fp", "n", total).select("doc_id", "fp", "component_id", "copies")


def _marks(text: Column, shingle: int) -> Column:
    """Fingerprint, identity of the shingle set and hashes of its MinHash bands, of one reading of a text."""

    @F.pandas_udf("array<long>")
    def udf(texts: pd.Series) -> pd.Series:
        draw = minhash.Bands()

        def marks(text: str | None) -> np.ndarray:
            hashes = shingles(text, shingle)
            return np.concatenate(([np.uint64(majority(hashes))], draw.sketch(hashes))).view(np.int64)

        return pd.Series([marks(t) for t in texts], dtype=object)

    return udf(text)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that of the smallest doc_id.

    Texts link where the Jaccard similarity of their sets of ``shingle`` words is
    ``similarity`` or more; a class is what links join. Fingerprints within
    ``max_distance`` propose pairs; as texts of such a similarity often differ by
    more bits, equal MinHash bands propose the rest, and every proposed pair is
    compared exactly (see :mod:`minhash`). Texts that are null or without words
    are alike. Where a class has several rows of the smallest id, the one of the
    smallest text hash stays, and of rows that agree in both, the first by all
    their columns. A null id stays only in a class without another. Other columns
    are kept as they are, whatever their names; an empty table stays empty. Texts
    are shuffled only where the list of rows to drop is too long to broadcast.
    """
    key = lambda: F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    drawn = docs.select(F.col(doc_id).alias("doc_id"), key().alias("key"), _marks(F.col(text), shingle).alias("marks"))
    light = drawn.select("doc_id", "key", F.get("marks", F.lit(0)).alias("fp"), F.get("marks", F.lit(1)).alias("grams"), F.slice("marks", 3, minhash.BANDS).alias("bands"))
    marked = written(light, "marks")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best")
    reps = written(marked.groupBy("grams").agg(best, F.min("fp").alias("fp"), F.min("bands").alias("bands")), "distinct")

    # Proposals as buckets of sets: a fingerprint, and each band, is one. Links of fingerprints join the buckets' pivots.
    prints = written(reps.groupBy("fp").agg(F.min("grams").alias("pivot"), F.count("*").alias("n")), "fingerprints")
    near = links(prints.select("fp"), max_distance)
    across = near.join(prints.select(F.col("fp").alias("a"), F.col("pivot").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("pivot").alias("y")), "b")
    across = written(across.select("x", "y", F.xxhash64(F.lit("link"), "x", "y").alias("bucket")), "proposed")
    own = reps.select("grams", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("print"), "fp")))).alias("bucket"))
    pairs = across.select(F.explode(F.array("x", "y")).alias("grams"), "bucket")
    members = own.unionByName(pairs)
    shared = members.groupBy("bucket").agg(F.min("grams").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = written(hot_join(members, shared, "bucket", "n", members.count()), "buckets")
    groups = components(buckets.where("grams <> pivot").select("pivot", "grams").distinct()).withColumnRenamed("node", "grams").withColumnRenamed("root", "home")
    groups = written(groups.distinct(), "groups")

    wanted = groups.join(reps, "grams").select("grams", F.col("best.doc_id").alias("want_id"), F.col("best.key").alias("want_key"))
    wanted = few(written(wanted, "wanted"))
    rows = docs.select(F.col(doc_id).alias("id"), key().alias("key"), F.col(text).alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("key") == F.col("want_key")))
    sets = written(minhash.sets(rows.select("grams", "text"), shingle).dropDuplicates(["grams"]), "shingle-sets")
    near = written(minhash.similar(sets, groups, buckets.select("grams", "bucket"), similarity), "near")
    return first_of_classes(docs, marked, reps, components(near), doc_id, text)


def first_of_classes(docs: DataFrame, marked: DataFrame, reps: DataFrame, roots: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that stay, given the class (node, root) of every linked set.

    ``marked`` holds (doc_id, key, grams) of every row, key being the text's hash,
    and ``reps`` (grams, best) the best row of each set.
    """
    key = lambda: F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rooted = reps.select("grams", "best").join(roots.withColumnRenamed("node", "grams"), "grams", "left").withColumn("root", F.coalesce("root", "grams"))
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    best = best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.key").alias("kept_key"))
    # Distinct (id, text) with their rows; those that stay once need nothing, all others are listed.
    times = written(marked.groupBy("doc_id", "key").agg(F.count("*").alias("times")), "times")
    told = times.join(best, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left")
    told = written(told.select(F.col("doc_id").alias("_told_id"), F.col("key").alias("_told_key"), "times", F.col("kept_key").isNotNull().alias("kept")).where("not kept or times > 1"), "listed")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("_id"), key().alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_told_id")) & (F.col("_key") == F.col("_told_key"))
    once = rows.join(few(told), same, "left_anti").select("row")
    again = rows.join(few(told.where("kept")), same).groupBy("_id", "_key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionAll(again).select("row.*")
