"""Hard negatives against DuckDB, against all pairs, and how many rows the bounds leave to score."""

import math
import random

import numpy as np
import pytest
from helpers import DATA, duck_rows, spark_rows
from pyspark.sql import functions as F

from fernmill.llm import hard_negatives as H
from fernmill.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec string, blk string, anchors string"


def plain(rows, positives=5, negatives=5, low=80, high=100, every=10):
    """All pairs, row by row."""
    known = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        own = (str(label), [max(-H.LIMIT, min(H.LIMIT, math.floor(256 * float(np.float32(x))))) for x in vec])
        known[vec_id] = min(known.get(vec_id, own), own)
    out = []
    for a, (label, vec) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v, strict=False)), i, other == label) for i, (other, v) in known.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, i) for n, i, same in scored if not same and low * -s <= -100 * n <= high * -s]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit[:negatives])]
    return sorted(out)


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(table, F.col("vec_id") % 10 == 0, **options).collect())


def vectors(rng, n, dims, centres=3, spread=0.1):
    middle = [[rng.gauss(0, 1) / dims**0.5 for _ in range(dims)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, spread) for m in middle[rng.randrange(centres)]], rng.randrange(3)) for i in range(n)]


def test_matches_duckdb(spark):
    assert spark_rows(QUERIES["op12_hard_negatives"](spark, str(DATA))) == duck_rows(SQL["op12_hard_negatives"])


@pytest.mark.parametrize("block", [7, 40, H.BLOCK])
def test_equals_all_pairs(spark, block):
    rows = vectors(random.Random(block), 160, 12)
    assert got(spark, rows, block=block) == plain(rows) != []


def test_other_windows(spark):
    rows = vectors(random.Random(1), 120, 6)
    assert got(spark, rows, positives=2, negatives=9, low=50, high=110) == plain(rows, 2, 9, 50, 110)


def test_ties_and_odd_rows(spark):
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, 0.25, -0.5], i % 2) for i in range(40)] + vectors(rng, 60, 3)
    rows = [(i, v, x) for i, (_, v, x) in enumerate(rows)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (200, None, 1), (210, [1.0, 0.0, 0.0], None), (220, [nan, 0.0, 1.0], 0), (230, [inf, 0.0, 1.0], 1), (240, [None, 0.0, 1.0], 1)]
    rows += [(250, [0.5], 0), (260, [], 1), (270, [0.5, 0.25, -0.5, 0.5, 0.5], 1), (280, [1e30, -1e30, 3.0], 0), (0, [0.25, 0.5, 0.0], 1), (10, [0.5, 0.25, -0.5], 0)]
    rows += rows[20:50]
    assert got(spark, rows) == got(spark, rows, block=9) == plain(rows)


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [0.5], 0), (3, [0.5], 1)]) == []
    assert got(spark, [(10, None, None)]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.normal(0, 0.125, (4_000, 64))).astype(np.int64)
    labels = [str(x) for x in rng.integers(0, 10, 4_000)]
    block = H.Block(np.arange(4_000), labels, vectors, H.edges(vectors[:1_000]))
    near, under = [], []
    for a in range(0, 4_000, 100):
        anchor = vectors[a]
        lower, upper = block.bounds(anchor)
        scores = block.vectors @ anchor
        assert (lower(slice(None)) <= scores).all() and (scores <= upper(slice(None))).all()
        _, best = H.positives_in(block, a, labels[a], anchor, 5, near)
        H.negatives_in(block, labels[a], anchor, [H.window(s, 80, 100) for s in best.tolist()], 5, under)
    # There are 400 rows of a label and 3,600 others.
    assert np.mean(near) < 40 and np.mean(under) < 360  # a tenth of either


def test_windows():
    for s in range(-30, 200):
        lo, hi = H.window(s, 80, 100)
        assert [n for n in range(-300, 300) if lo <= n <= hi] == [n for n in range(-300, 300) if 80 * s <= 100 * n <= 100 * s]
