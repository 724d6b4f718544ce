"""Fingerprints, links and classes against brute force over all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fernmill.llm import simhash as S
from fernmill.llm.graph import components


def slow_simhash(text, shingle=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps):
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_fingerprint_is_the_slow_one():
    rng = random.Random(3)
    texts = ["", None, "one", "Two  words", "a b c d", "É A b\x0bc", " ".join(rng.choices(["the", "Of", "é", "x1"], k=300))]
    assert [S.simhash(t) for t in texts] == [slow_simhash(t) for t in texts]
    assert S.simhash("x y z " * 100_000) == slow_simhash("x y z " * 100_000)


def test_every_pair_within_four_bits_meets_in_a_tree():
    rng, gen = random.Random(5), np.random.default_rng(5)
    fps = [rng.getrandbits(64) for _ in range(2000)]
    fps = np.unique(np.array(fps + [flipped(rng, x, rng.randint(1, 4)) for x in fps], np.uint64))
    met, wanted = set(), set()
    for mask in S.masks():
        leaves = []
        tree = S.grow(fps, 1.0, mask, 1, gen, leaves, 100)
        assert len(leaves) > 20
        for _, own in S.shards(fps, tree, mask, 1):
            near = np.argwhere(np.bitwise_count(own[:, None] ^ own) <= 4)
            met |= {(int(own[i]), int(own[j])) for i, j in near if i != j}
    wanted = {(int(fps[i]), int(fps[j])) for i, j in np.argwhere(np.bitwise_count(fps[:, None] ^ fps) <= 4) if i != j}
    assert len(wanted) >= 4000 and met == wanted


def test_comparisons_grow_slowly():
    """Sixteen times the fingerprints take a fifth of that in comparisons of each."""
    gen, per = np.random.default_rng(6), []
    for n in (8_000, 128_000):
        counted = []
        fps = np.unique(gen.integers(0, 1 << 64, n, np.uint64))
        for mask in S.masks():
            for _ in S.close_pairs(fps, mask, 1, 4, counted):
                pass
        per.append(sum(counted) / n)
    assert per[1] < 3.2 * per[0] and per[1] < 128_000 / 40


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(fps)[:8]:  # chains and dense groups
        at = seed
        for _ in range(12):
            at = flipped(rng, at, rng.randint(1, 4))
            fps |= {at, flipped(rng, seed, rng.randint(1, 5))}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for block, shard in ((4096, 4096), (4096, 40), (8, 8192)):  # a small block deals every shard out in pairs of blocks
        roots = {r.node: r.root for r in components(S.links(df, shard=shard, block=block)).collect()}
        got = [roots.get(signed(x), signed(x)) for x in fps]
        want = slow_classes(fps)
        assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_spanning_forest_of_a_dense_shard():
    rng = random.Random(9)
    x = rng.getrandbits(64)
    members = np.unique(np.array([flipped(rng, x, 2) for _ in range(500)] + [rng.getrandbits(64) for _ in range(50)], np.uint64))
    src, dst = S._links_within(members, 4)
    assert sum(map(len, src)) <= len(members) - 1
    for a, b in zip(np.concatenate(src), np.concatenate(dst), strict=True):
        assert (int(a) ^ int(b)).bit_count() <= 4


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (5, 4)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_classes_on_edge_rows(spark, edges, nothing):
    rows = S.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    zero = [r for r in rows if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2} and {r.copies for r in zero} == {4}
    assert [r.component_id for r in rows if r.doc_id == 1] == [1, 1]
    assert S.near_duplicates(nothing).count() == 0


def test_one_of_each_planted_group_stays(spark):
    rng = random.Random(13)
    words = lambda n: [f"{rng.choice('bcdfgh')}{rng.randint(0, 9999)}" for _ in range(n)]
    rows = []
    for g in range(5):
        base = words(400)
        rows += [(g * 10, " ".join(base)), (g * 10 + 1, " ".join(base)), (g * 10 + 2, " ".join(base).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.deduplicate(df).collect()) == [0, 10, 20, 30, 40]
    got = df.select("doc_id", S.as_hex(S.fingerprint(F.col("text"))).alias("h")).collect()
    assert all(r.h == f"{slow_simhash(t):016x}" for r, (_, t) in zip(sorted(got), sorted(rows), strict=True))
