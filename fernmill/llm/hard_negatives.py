"""Hard-negative mining over a vector-approximation file.

Vectors become integers and are written in blocks, the vector-approximation file:
beside the vectors themselves, each dimension of a row is one of ``CELLS`` cells,
and a block knows the least and the greatest value that it has in each cell. For
an anchor, a table of products by dimension and cell bounds every row's score from
below and above by look-ups alone. Only rows that may still enter are scored:

* positives: rows of the label whose upper bound reaches the ``k``-th best lower bound;
* negatives: rows of other labels whose bounds meet a window under a positive's
  score, and whose upper bound reaches the ``k``-th best lower bound of the rows
  that are in the window for certain.

Anchors are a stated query set. They go out in groups to all blocks, and each
block answers with its own best few, of which the best few are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernmill.llm.graph import streamed_groups
from fernmill.llm.scratch import written

#: Components are floor(SCALE * x); beyond +-LIMIT they count as that, so that scores fit a long.
SCALE = 256
LIMIT = 1 << 24
#: Cells of a dimension. Their edges are quantiles of SAMPLE rows (fewer of long vectors: SAMPLE_VALUES values in all).
CELLS = 64
SAMPLE, SAMPLE_VALUES = 4_096, 1 << 20
#: Rows of a block and anchors of a group, on average.
BLOCK, GROUP = 8_192, 256
SEED = 42


def matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of at most ``dims`` integers, zeros where they are shorter."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def edges(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The inner edges of each dimension's cells, by quantiles; (dims, cells - 1)."""
    if not len(sample):
        return np.zeros((sample.shape[1], cells - 1), np.int64)
    return np.sort(sample, axis=0)[np.arange(1, cells) * len(sample) // cells].T.copy()


class Block:
    """Rows sorted by label and id, with their cells and the values that cells hold here."""

    def __init__(self, ids: np.ndarray, labels: list[str], vectors: np.ndarray, cuts: np.ndarray) -> None:
        order = np.lexsort((ids, np.array(labels, object)))
        self.ids, self.vectors = ids[order], vectors[order]
        self.names, self.starts = np.unique(np.array(labels, object)[order], return_index=True)
        dims, cells = len(cuts), cuts.shape[1] + 1 if cuts.ndim == 2 else 1
        self.place = np.empty((dims, len(ids)), np.int64)
        self.least, self.most = np.zeros((dims, cells), np.int64), np.zeros((dims, cells), np.int64)
        for d in range(dims):
            own = np.searchsorted(cuts[d], self.vectors[:, d], "right")
            low, high = np.full(cells, LIMIT), np.full(cells, -LIMIT)
            np.minimum.at(low, own, self.vectors[:, d])
            np.maximum.at(high, own, self.vectors[:, d])
            held = low <= high
            self.least[d][held], self.most[d][held] = low[held], high[held]
            self.place[d] = own + d * cells

    def rows_of(self, label: str) -> tuple[int, int]:
        """Where the rows of a label are."""
        k = int(np.searchsorted(self.names, label))
        if k == len(self.names) or self.names[k] != label:
            return 0, 0
        return int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else len(self.ids)

    def bounds(self, anchor: np.ndarray) -> tuple[Callable, Callable]:
        """Functions of a row selection: lower and upper bounds of the scores with ``anchor``."""
        x, y = anchor[:, None] * self.least, anchor[:, None] * self.most
        lower, upper = np.minimum(x, y).ravel(), np.maximum(x, y).ravel()
        return (lambda rows: lower.take(self.place[:, rows]).sum(0)), (lambda rows: upper.take(self.place[:, rows]).sum(0))


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def kth(values: np.ndarray, k: int) -> int | None:
    """The k-th greatest value; None if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def positives_in(block: Block, anchor_id: int, label: str, anchor: np.ndarray, k: int, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's first ``k`` other rows of a label. ``scored`` gathers how many were scored."""
    lo, hi = block.rows_of(label)
    rows = np.arange(lo, hi)[block.ids[lo:hi] != anchor_id]
    if not len(rows):
        return rows, rows
    lower, upper = block.bounds(anchor)
    if (least := kth(lower(rows), k)) is not None:
        rows = rows[upper(rows) >= least]
    if scored is not None:
        scored.append(len(rows))
    scores = block.vectors[rows] @ anchor
    best = first(scores, block.ids[rows], k)
    return block.ids[rows[best]], scores[best]


def negatives_in(block: Block, label: str, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, scored: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ids and scores of the block's first ``k`` rows of other labels within it."""
    lo, hi = block.rows_of(label)
    none = np.zeros(0, np.int64)
    open_ = [w for w in windows if w[0] <= w[1]]
    if not open_ or hi - lo == len(block.ids):
        return [(none, none)] * len(windows)
    lower, upper = block.bounds(anchor)
    most = upper(slice(None))
    may = most >= min(w[0] for w in open_)
    may[lo:hi] = False
    rows = np.flatnonzero(may)
    most, least = most[rows], lower(rows)
    wanted = np.zeros(len(rows), bool)
    for low, high in open_:
        sure = kth(least[(least >= low) & (most <= high)], k)
        wanted |= (most >= (low if sure is None else sure)) & (least <= high)
    rows = rows[wanted]
    if scored is not None:
        scored.append(len(rows))
    scores = block.vectors[rows] @ anchor
    order = first(scores, block.ids[rows], len(rows))
    rows, scores = rows[order], scores[order]
    out = []
    for low, high in windows:
        own = np.flatnonzero((scores >= low) & (scores <= high))[:k]
        out.append((block.ids[rows[own]], scores[own]))
    return out


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest n with ``low * score <= 100 * n <= high * score``; empty if the first is greater."""
    return -(-low * score // 100), high * score // 100


def _packed(dims: int, cuts: np.ndarray):
    """Blocks of the file, from rows (blk, id, label, vec) sorted by blk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in streamed_groups(batches):
            vectors = matrix(rows.column("vec"), dims)
            block = Block(rows.column("id").to_numpy(), rows.column("label").to_pylist(), vectors, cuts)
            sizes = np.diff(np.append(block.starts, len(block.ids)))
            place = block.place - np.arange(dims)[:, None] * CELLS
            data = [block.ids, block.vectors.astype(np.int32), place.astype(np.uint8), block.least.astype(np.int32), block.most.astype(np.int32)]
            columns = [pa.array([rows.column(0)[0].as_py()], pa.int64()), pa.array([block.names.tolist()], pa.list_(pa.string())), pa.array([sizes.tolist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in data)]
            yield pa.RecordBatch.from_arrays(columns, names=_FILE)

    return run


_FILE = ["blk", "names", "sizes", "ids", "vectors", "cells", "least", "most"]
_FILE_SCHEMA = "blk long, names array<string>, sizes array<long>, ids binary, vectors binary, cells binary, least binary, most binary"


def _opened(row: dict, dims: int) -> Block:
    """A block as it was written."""
    block, n = Block.__new__(Block), sum(row["sizes"])
    block.names, block.starts = np.array(row["names"], object), np.cumsum([0, *row["sizes"]])[:-1]
    block.ids = np.frombuffer(row["ids"], np.int64)
    block.vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, dims).astype(np.int64)
    block.place = np.frombuffer(row["cells"], np.uint8).reshape(dims, n) + np.arange(dims)[:, None] * CELLS
    block.least, block.most = (np.frombuffer(row[c], np.int32).reshape(dims, CELLS).astype(np.int64) for c in ("least", "most"))
    return block


def _asked(file: DataFrame, anchors: DataFrame, blocks: int, dims: int, answer: Callable, schema: str) -> DataFrame:
    """``answer`` of each block to each anchor: rows of the file meet the anchors' groups, the block coming first."""
    groups = max(1, -(-anchors.count() // GROUP))
    own = F.struct(*anchors.columns)
    asked = anchors.groupBy(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(groups)).alias("g")).agg(F.collect_list(own).alias("anchors"))
    asked = asked.select("anchors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("blk"))
    met = file.unionByName(asked, allowMissingColumns=True).repartition(min(2 * blocks, 20_000), "blk").sortWithinPartitions("blk", F.col("anchors").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, block = -1, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if not row["anchors"].is_valid:
                    blk, block = row["blk"].as_py(), _opened({c: row[c].as_py() for c in _FILE}, dims)
                elif row["blk"].as_py() == blk:
                    found = [x for a in row["anchors"].as_py() for x in answer(block, a)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return met.mapInArrow(run, schema)


def _padded(vector: list[int], dims: int) -> np.ndarray:
    return np.array(vector + [0] * (dims - len(vector)), np.int64)


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says of a row of ``rows`` whether it asks. Its positives are its
    first ``positives`` other rows of its label; for each, the first ``negatives``
    rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's. Scores are inner products of floor(256 * x); higher come first,
    ties by smaller id. Rows with a null id, label or vector, or a component that
    is null or not finite, take no part. Vectors of several lengths count as if
    zeros followed the shorter. Of rows that share an id, the least by label and
    vector counts. Other columns are ignored; an empty table gives no rows.
    """
    vec = F.col(vector)
    numbers = F.transform(vec, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(float(SCALE)) * x.cast("double")))).cast("int"))
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & vec.isNotNull() & ~odd
    known = rows.where(usable).select(F.col(vec_id).cast("long").alias("id"), F.struct(F.col(label).cast("string").alias("label"), numbers.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("asks")).alias("x"))
    table = written(known.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.label", "x.vec", "x.asks"), "vectors")

    total, dims = table.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    some = table.select("id", "vec").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(min(SAMPLE, max(CELLS, SAMPLE_VALUES // max(dims, 1)))).collect()
    cuts = edges(np.array([r["vec"] + [0] * (dims - len(r["vec"])) for r in some], np.int64).reshape(len(some), dims))
    blocks = max(1, -(-total // block))
    dealt = table.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("blk"), "id", "label", "vec").repartition(min(2 * blocks, 20_000), "blk").sortWithinPartitions("blk")
    file = written(dealt.mapInArrow(_packed(dims, cuts), _FILE_SCHEMA), "approximations")

    def near(held: Block, a: dict) -> Iterator[tuple]:
        ids, scores = positives_in(held, a["id"], a["label"], _padded(a["vec"], dims), positives)
        return ((a["id"], i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))

    def under(held: Block, a: dict) -> Iterator[tuple]:
        windows = [window(p["score"], low, high) for p in a["positives"]]
        found = negatives_in(held, a["label"], _padded(a["vec"], dims), windows, negatives)
        return ((a["id"], p["positive_id"], p["score"], i, s) for p, (ids, scores) in zip(a["positives"], found, strict=True) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))

    asking = table.where("asks").drop("asks")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = _asked(file, asking, blocks, dims, near, "anchor_id long, positive_id long, score long")
    chosen = chosen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    chosen = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    having = written(asking.join(chosen, "id"), "positives")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = _asked(file, having, blocks, dims, under, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(rows: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings``: every hundredth id asks, and every seventh has the next label instead of its own."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM usable a JOIN usable r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
