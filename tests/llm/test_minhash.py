"""Near copies by Jaccard similarity against comparing all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from fernmill.llm import minhash as M
from fernmill.llm import simhash as S
from fernmill.llm.graph import components


def slow_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_all_pairs(texts):
    sets, group = {i: slow_sets(t) for i, t in texts.items()}, {}
    for i in sorted(sets):
        near = {group[j] for j in group if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        own = min(near, default=i)
        group[i] = own
        group.update({j: own for j in group if group[j] in near})
    return set(group.values())


def edited(rng, groups, copies=(0, 3, 5, 6, 9, 14)):
    """Groups of texts of similarities from 0.6 to 0.95."""
    texts = {}
    for g in range(groups):
        base = [f"{rng.choice('bcdfgh')}{rng.randint(0, 9999)}" for _ in range(300)]
        for k, edits in enumerate(copies):
            words = list(base)
            for at in rng.sample(range(300), edits):
                words[at] = f"z{rng.randint(0, 9999)}"
            texts[g * 100 + k] = " ".join(words)
    return texts


def test_stage_drops_near_copies_beyond_four_bits(spark):
    texts = edited(random.Random(17), 30)
    want = kept_by_all_pairs(texts)
    far = [k for g in range(30) for k in (1, 2, 3) if (S.simhash(texts[g * 100]) ^ S.simhash(texts[g * 100 + k])).bit_count() > 4]
    assert len(far) > 10 and len(want) > 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in C.drop_copies(spark, docs, "").collect()} == want


def test_similar_pairs_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 400, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(300, 400)), replace=False), rng.integers(0, 1 << 64, 3, np.uint64)])) for _ in range(60)]
    for columns in (1 << 16, 128):
        M.COLUMNS = columns
        i, j = M.similar_pairs(np.concatenate(sets), np.array([len(s) for s in sets]), 0.8)
        group = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])):
                    own = {group[a], group[b]}
                    group = [min(own) if g in own else g for g in group]
        got = list(range(len(sets)))
        for a, b in zip(i, j, strict=True):
            own = {got[a], got[b]}
            got = [min(own) if g in own else g for g in got]
        assert got == group and 1 < len(set(group)) < 60 and len(i) == 60 - len(set(group))
    M.COLUMNS = 1 << 16


def test_large_groups_go_by_bucket_and_block(spark):
    """However small the tasks, the same classes come out."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 100)
    rows = [(k, sorted({int(x) for x in np.concatenate([base[rng.permutation(100)[:92]], rng.integers(0, 1 << 62, 3)])})) for k in range(40)]
    sets = spark.createDataFrame(rows, "grams long, set array<long>")
    groups = sets.select("grams", F.lit(0).cast("long").alias("home"))
    buckets = sets.select("grams", F.explode(F.expr("array(1L, 2L)")).alias("bucket"))
    want = None
    for group in (1 << 20, 2_000, 300):
        found = {r.node: r.root for r in components(M.similar(sets, groups, buckets, 0.8, group)).collect()}
        want = want or found
        assert found == want and len(found) > 10


def test_edge_rows(spark, edges, nothing):
    kept = S.deduplicate(edges)
    assert kept.columns == edges.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert ids == sorted([(False, i) for i in (1, 2, 5, 6, 7, 8, 9, 10, 11)] + [(True, None)])
    assert S.deduplicate(nothing).count() == 0


def test_ties_fall_alike(spark):
    rows = [("a", "one two three four five six", x) for x in ("q", "p", "r")] + [("b", "one two three four five six", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string, grams string")
    assert [tuple(r) for r in S.deduplicate(df).collect()] == [("a", "one two three four five six", "p")]


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id for r in S.deduplicate(docs).collect()} == kept_by_all_pairs({r.doc_id: r.text for r in docs.collect()})
