"""Pairs of shingle sets by MinHash bands, and their exact Jaccard similarity.

Sets of one bucket are candidates. Buckets that share members make a group;
each task gets the whole sets of a group, once, and finds the similar pairs by
counting common bits, one for each shingle. A group of too many shingles or sets
for a task is taken bucket by bucket, and a bucket too large goes out in pairs of blocks, so that a
task's memory stays bounded and no pair of a bucket is left out. Only a spanning
forest of the links leaves a task. Five rows a band and 32 bands leave a pair of
similarity 0.8 unproposed 3 times in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernmill.llm.graph import hot_join, spanning, streamed_groups
from fernmill.llm.scratch import written
from fernmill.llm.shingles import shingle_set, shingles

BANDS, ROWS = 32, 5
SEED = 43
#: Shingles hashed at once.
CHUNK = 512
#: Shingles of one group that a task holds once or twice, and sets, whose common shingles are counted in a square.
GROUP, MEMBERS = 1 << 19, 2_048
#: Shingles that are bits at a time, and texts whose sets leave a worker together.
COLUMNS, PIECE = 1 << 16, 256


class Bands:
    """Draws MinHash bands."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.flips, self.factors = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
        self.factors |= np.uint64(1)

    def sketch(self, hashes: list[int]) -> np.ndarray:
        """The identity of a shingle set, and the hash of each band of its MinHash; sets without shingles are alike."""
        grams = shingle_set(hashes)
        least = np.full(len(self.flips), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), CHUNK):
            hashed = grams[at : at + CHUNK, None] ^ self.flips
            hashed *= self.factors
            np.minimum(least, hashed.min(axis=0), out=least)
        mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            mixed = (mixed ^ row) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.concatenate(([np.uint64(xxhash.xxh64_intdigest(grams.tobytes()))], mixed))


def sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(grams, set): the shingle sets, as arrays of longs, of texts (grams, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PIECE):
                part = batch.slice(at, PIECE)
                found = [shingle_set(shingles(t.as_py(), shingle)).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["grams", "set"])

    return texts.select("grams", "text").mapInArrow(run, "grams long, set array<long>")


def _shared(rows: np.ndarray, columns: np.ndarray, n: int, width: int) -> np.ndarray:
    """How many shingles each pair of ``n`` sets shares."""
    out = np.zeros((n, n), np.int32)
    for left in range(0, width, COLUMNS):
        own = (columns >= left) & (columns < left + COLUMNS)
        span = -(-min(COLUMNS, width - left) // 64)
        bits = np.zeros((n, span), np.uint64)
        at = columns[own] - left
        np.bitwise_or.at(bits, (rows[own], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        for i in range(n - 1):
            out[i, i + 1 :] += np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int32)
    return out + out.T


def similar_pairs(values: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that join all sets of the similarity; the sets lie one after another in ``values``."""
    n, per = len(sizes), round(threshold * 1000)
    if n == 2:
        both = len(np.intersect1d(values[: sizes[0]], values[sizes[0] :], assume_unique=True))
        near = both * (1000 + per) >= per * int(sizes.sum())
        return (np.array([0]), np.array([1])) if near else (np.empty(0, np.int64), np.empty(0, np.int64))
    _, columns, often = np.unique(values, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    common = often > 1
    at = np.cumsum(common) - 1
    rows, columns = rows[common[columns]], at[columns[common[columns]]]
    both = _shared(rows, columns, n, int(common.sum()))
    near = both * (1000 + per) >= per * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(near, False)
    return spanning(near)


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src: list[np.ndarray] = []
        dst: list[np.ndarray] = []
        held = 0
        for group in streamed_groups(batches):
            if len(group) < 2:
                continue
            group = group.combine_chunks()
            lists = group.column(2).chunk(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            grams = group.column(1).to_numpy()
            i, j = similar_pairs(values, np.diff(lists.offsets.to_numpy()), threshold)
            src.append(grams[i])
            dst.append(grams[j])
            held += len(i)
            if held >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], names=["a", "b"])
                src, dst, held = [], [], 0
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], names=["a", "b"])

    return run


def similar(sets: DataFrame, groups: DataFrame, buckets: DataFrame, threshold: float, group: int = GROUP) -> DataFrame:
    """Links (a, b) that join all candidates of the similarity.

    ``sets`` has (grams, set), ``groups`` (grams, home) and ``buckets`` (grams,
    bucket); candidates are sets of one bucket, and a bucket lies within a home.
    """
    # A set weighs its shingles, and a small one enough that no group has more than MEMBERS.
    weight = F.greatest(F.size("set"), F.lit(group // MEMBERS)).cast("long").alias("size")
    sized = written(groups.join(sets.select("grams", weight), "grams"), "sized")
    homes = sized.groupBy("home").agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    total = sized.count()
    small = homes.where(F.col("weight") <= group).select("home", "n")
    large = homes.where(F.col("weight") > group).select("home", "n")
    whole = hot_join(sized, small, "home", "n", total).select("home", "grams", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    # Sets of a large group, by bucket, and by pairs of blocks where that is large too.
    wide = hot_join(sized, large, "home", "n", total).select("grams", "size")
    by_bucket = written(buckets.join(wide, "grams").select(F.xxhash64(F.lit("bucket"), "bucket").alias("home"), "grams", "size"), "by-bucket")
    parts = by_bucket.groupBy("home").agg(F.ceil(F.sum("size") / F.lit(group)).alias("parts"), F.count("*").alias("n"))
    cut = hot_join(by_bucket, parts.where("n > 1"), "home", "n", by_bucket.count())
    cut = cut.withColumn("own", F.pmod(F.xxhash64("grams"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cut = cut.select("home", "grams", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = whole.unionByName(cut).select(F.xxhash64("home", "i", "j").alias("deal"), "grams").distinct().join(sets, "grams").select("deal", "grams", "set")
    return dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(_links(threshold), "a long, b long").distinct()
