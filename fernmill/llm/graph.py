"""Joins that hold under hot keys, groups streamed through Python, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernmill.llm.scratch import written

#: Keys that may hold over one part in so many of all rows: fewer than this many, so they can be broadcast.
HOT_KEYS = 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``count`` its rows in ``left``.

    ``total`` is at least the sum of the counts, so fewer than ``HOT_KEYS`` keys
    have more than ``total / HOT_KEYS`` rows. Those are broadcast, so that no task
    gets the rows of a hot key; the others are shuffled.
    """
    bound = max(total // HOT_KEYS, 1)
    hot, cold = (right.where(x).drop(count) for x in (F.col(count) > bound, F.col(count) <= bound))
    found = left.join(F.broadcast(hot), key)
    return found.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def streamed_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of an equal first column, over batches sorted by it; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[0].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cuts.tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of a symmetric matrix of links."""
    label = np.arange(len(near))
    src, dst = [], []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        others = np.flatnonzero(near[i])
        found, first = np.unique(label[others], return_index=True)
        new = found != label[i]
        if new.any():
            src += [i] * int(new.sum())
            dst += others[first[new]].tolist()
            label[np.isin(label, found[new])] = label[i]
    return np.array(src, np.int64), np.array(dst, np.int64)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Point every larger neighbour of a node at the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = least.select("a", F.least("a", "m").alias("m"), "n")
    return hot_join(both, least, "a", "n", 2 * total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = hot_join(down, least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node with a link; root is the smallest node reachable.

    ``edges`` has two columns of one type; loops and repeats are allowed, rows
    with a null join nothing. Each half of a round is written to the shared
    folder, and centres of large stars are joined apart. The alternating
    large-star and small-star steps need about log(n) rounds; running past
    ``max_rounds`` raises instead of returning unfinished labels. An empty table
    gives none.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    now, mark = written(now, "edges"), None
    total = now.count()
    for _ in range(max_rounds):
        large = written(_large_star(now, total), "stars")
        # Each edge points one node at a smaller one, so no step makes more edges than twice those before.
        now = written(_small_star(large, 2 * total), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark, total = tuple(seen), seen[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
