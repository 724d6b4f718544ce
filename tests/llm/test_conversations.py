"""Conversation repair against DuckDB, and against a plain search over whole scripts."""

import hashlib
import random
import sys
import zlib
from functools import cache

import pytest
from helpers import DATA, duck_rows, spark_rows
from pyspark.sql import functions as F

from fernmill.llm import conversations as C
from fernmill.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, seq string, key string, n string"
FITTING = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(C.WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, repaired) by trying every script with at most two inserts at a place."""
    fault = faults(rows)

    @cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def go(cost, letter, said, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], said + rest[2]))

        if inserts < 2:
            for x in set("ua") & set(FITTING[state]):
                go(2, "I", ({"u": "user:", "a": "assistant:"}[x],), best(i, x, inserts + 1))
        if i < len(rows):
            (role, text), cut = rows[i], fault[i] == "truncated"
            go(3, "D", (), best(i + 1, state, 0))
            if fault[i] in ("", "truncated"):
                if role[:1] in FITTING[state] and role[:1]:
                    go(cut, "K", (f"{role}:{text}",), best(i + 1, role[0], 0))
                for x in ("user", "assistant"):
                    if x[0] in FITTING[state]:
                        go(2 + cut, "R", (f"{x}:{text}",), best(i + 1, x[0], 0))
        return min(found, default=None)

    return best(0, "", 0)


def expected(rows):
    """By conversation: faults, illegal steps and the repair, of (conv, turn, role, text) rows."""
    said = lambda x: " " if x is None else x
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, said(r), hashlib.sha256(said(x).encode()).digest(), said(x)) for c, t, r, x, *_ in rows if c == conv), key=lambda z: z[:4])
        lines = [(r, x) for *_, r, _, x in own]
        cost, audit, said_ = plain(lines)
        fault, turns = faults(lines), [t for known, t, *_ in own if known]
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(lines, lines[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said_).encode()).hexdigest())
    return out


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    found = C.repair(table, **options)
    sha = {r.conv: r.sha256 for r in found.digests().collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv, hashlib.sha256().hexdigest())) for r in found.report.collect()}


def conversation(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = ["Yes.", "No", " ", None, "Why?", "well\n", "é!", ""]
    return [(conv, rng.choice([None, *range(n + 2)]) if rng.random() < 0.2 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{t} is said.") for t in range(n)]


def test_matches_duckdb(spark):
    assert spark_rows(QUERIES["op11_conversations"](spark, str(DATA))) == duck_rows(SQL["op11_conversations"])


@pytest.mark.parametrize("block_bits", [1, 3, C.BLOCK_BITS])
def test_equals_a_plain_search(spark, block_bits):
    rng = random.Random(block_bits)
    rows = [r for conv in [None, *range(60)] for r in conversation(rng, conv, rng.randrange(1, 14))]
    rng.shuffle(rows)
    assert got(spark, rows, block_bits=block_bits) == expected(rows)


def test_rows_that_repeat_are_one_step(spark):
    rows = [(1, 0, "user", "Hi.")] * 3_000 + [(1, 1, "assistant", "Ho.")] * 2 + [(1, 1, "assistant", "")] * 2_000
    _, blank, duplicate, truncated, illegal, cost, audit, sha = got(spark, rows)[1]
    assert (blank, duplicate, truncated, illegal, cost) == (2_000, 3_000, 0, 5_000, 15_000)
    assert sorted(audit) == sorted("KK" + "D" * 5_000) and sha == hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()
    # The last row carries the insert that its copies' deletes go before.
    assert got(spark, [(1, 0, "user", "Hi.")] * 3)[1][6] == "KDDI"


def test_a_conversation_over_many_blocks(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{t}" + rng.choice([".", ""])) for t in range(400)]
    whole = got(spark, rows)
    assert got(spark, rows, block_bits=2) == whole
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert whole == expected(rows)
    finally:
        sys.setrecursionlimit(limit)


def test_blocks_agree_with_the_whole():
    rng = random.Random(11)
    for _ in range(300):
        codes = [4 * rng.randrange(4) + rng.randrange(4) for _ in range(rng.randrange(2, 12))]
        whole = C.distances(codes, list(C.END), True)
        cut = rng.randrange(1, len(codes))
        late = C.distances(codes[cut:], list(C.END), True)
        early = C.distances(codes[:cut], late[:4], False)
        assert [early[s] for s in range(4)] == whole[:4]
        left, state = C.walk(codes[:cut], early, 0, False)
        right, _ = C.walk(codes[cut:], late, state, True)
        assert left + right == C.walk(codes, whole, 0, True)[0]


def test_damage(spark):
    rows = [(c, t, "assistant", f"{c}. {t}! ok?") for c in range(20) for t in range(6)] + [(None, None, None, None)]
    found = sorted((tuple(r) for r in C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if h == 1 else text.replace(".", "").replace("!", "").replace("?", "") if h == 2 else text
        want += [(c, t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    assert found == sorted(want, key=repr)


def test_empty_and_odd_tables(spark):
    assert got(spark, []) == {}
    nothing = spark.createDataFrame([], SCHEMA)
    assert C.damaged_and_repaired(nothing).count() == 0
    rows = [(1, None, None, None), (1, None, "user", "x" * 300_000), (2, -5, "assistant", "Ends. " * 20_000), (None, 3, "system", "\t\n")]
    assert got(spark, rows) == expected(rows)
    assert C.damaged_and_repaired(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)).select(F.count("*")).first()[0] == 3
