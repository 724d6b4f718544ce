"""Mixing: targets, flows against enumeration, selection against DuckDB."""

import itertools
import random

from helpers import DATA, duck_rows, spark_rows

from fernmill.llm import mixing as M
from fernmill.llm.queries import QUERIES


def test_matches_duckdb(spark):
    assert spark_rows(QUERIES["op7_mixing"](spark, str(DATA))) == duck_rows(M.SQL)


def test_targets():
    sizes = {"b": 10, "a": 1000, None: 100, "c": 1000}
    goal = M.targets(sizes)
    assert list(goal) == ["a", "b", "c", None]
    assert all(goal[s] <= 2 * sizes[s] + 1e-9 for s in sizes) and abs(sum(goal.values()) - 1.5 * 2110) < 1e-6
    assert goal["b"] == 20 and goal[None] == 200 and goal["a"] == 2000
    assert M.targets({}) == {} and M.targets({"a": 0}) == {"a": 0.0}


def best(patterns, quotas, copies=2):
    """Largest total, then fewest repeats, over all integer flows of a tiny case."""
    ways = [(k, s) for k in patterns for s in k]
    found = (-1, 0)
    for amounts in itertools.product(range(5), repeat=len(ways)):
        per = {k: sum(a for (p, _), a in zip(ways, amounts, strict=True) if p == k) for k in patterns}
        if all(per[k] <= copies * patterns[k] for k in patterns) and all(sum(a for (_, s), a in zip(ways, amounts, strict=True) if s == q) <= quotas[q] for q in quotas):
            found = max(found, (sum(amounts), -sum(max(0, per[k] - patterns[k]) for k in patterns)))
    return found


def test_route_is_the_cheapest_largest_flow():
    rng = random.Random(1)
    for _ in range(25):
        patterns = {("a",): rng.randint(0, 2), ("a", "b"): rng.randint(1, 2), ("b", "c"): rng.randint(0, 2)}
        quotas = {s: rng.randint(0, 4) for s in "abc"}
        got = M.route(patterns, quotas)
        per = {k: sum(v.values()) for k, v in got.items()}
        assert (sum(per.values()), -sum(max(0, per[k] - patterns[k]) for k in patterns)) == best(patterns, quotas)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, size long, members array<string>, copies string, n long")


def test_overlapping_sources(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 40), rng.choice([["a"], ["b"], ["a", "b"], ["b", "a"], ["c"]]), "x", 1) for i in range(600)]
    mixed, sizes, goal = M.mix(docs(spark, rows))
    got = mixed.collect()
    assert len(got) == 600 and mixed.columns.count("copies") == 1
    patterns = {}
    for _, size, members, _, _ in rows:
        patterns[tuple(sorted(members))] = patterns.get(tuple(sorted(members)), 0) + size
    routed = M.route(patterns, {s: int(t + 0.5) for s, t in goal.items()})
    for s in "abc":
        assert sizes[s] == sum(r[1] for r in rows if s in r[2])
        taken = sum(r.size * r.taken_by.count(s) for r in got)
        # Each end of a source's stretch of a pattern misses by half a document at most.
        assert abs(taken - sum(given.get(s, 0) for given in routed.values())) <= 4 * 20
    assert all(r.copies <= 2 and len(r.taken_by) == r.copies and set(r.taken_by) <= set(r.members) for r in got)
    again = {r.doc_id: r.copies for r in M.mix(docs(spark, rows).repartition(7))[0].collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_edge_rows(spark, edges, nothing):
    got = M.by_source(edges).collect()
    assert len(got) == edges.count() and all(r.taken <= 2 * r.size for r in got)
    assert {r.target for r in got if r.source is None} == {24.0}  # null is a source, the last and of the smallest weight
    assert M.by_source(nothing).count() == 0
    rows = [(1, None, ["a"], "x", 1), (2, 5, None, "x", 1), (3, 5, [], "x", 1), (None, 5, [None, "a"], "x", 1)]
    assert {r.doc_id: r.copies for r in M.mix(docs(spark, rows))[0].collect() if r.doc_id} == {1: 0, 2: 0, 3: 0}


def test_a_source_for_each_document(spark):
    """As many patterns as documents: nothing is refused, and the flow is a star for each source."""
    rows = [(i, 1 + i % 3, [f"s{i}"], "x", 1) for i in range(12_000)]
    got, sizes, goal = M.mix(docs(spark, rows))
    assert len(sizes) == 12_000 and got.where("copies > 0").count() > 6_000
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1


def test_no_document_is_shuffled(spark, edges):
    """Documents meet the plan by a broadcast join: no exchange holds their text."""
    mixed, _, _ = M.mix(edges.selectExpr("*", "array(source) as members", "1L as size").drop("copies"))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_alike_rows_fall_alike(spark):
    rows = [(1, 10, ["a"], "x", 1)] * 5 + [(2, 10, ["b"], "x", 1), (None, 4, ["a"], "x", 1), (None, 4, ["a"], "x", 1)]
    got = M.mix(docs(spark, rows))[0].collect()
    assert len({r.copies for r in got if r.doc_id == 1}) == 1 and len({r.copies for r in got if r.doc_id is None}) == 1


def test_every_pattern_goes_through_the_flow(spark, monkeypatch):
    counts, plain = [], M.route
    monkeypatch.setattr(M, "route", lambda patterns, quotas, most=M.MAX_COPIES: plain(patterns, quotas, most, counts))
    rows = [(i, " ".join("w" * (i % 7)), "abc"[i % 3]) for i in range(90)] + [(90, "x y", None)]
    got = M.by_source(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert counts[0] == 4 and counts[1] >= 4 and len(got) == 91
    alone = {("a",): 10, ("b",): 7, ("c",): 0}
    assert plain(alone, {"a": 13, "b": 90, "c": 5}) == {("a",): {"a": 13}, ("b",): {"b": 14}, ("c",): {}}
