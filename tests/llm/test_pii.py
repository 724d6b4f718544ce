"""Personal data: the base patterns as they are stated, and discovery from contexts."""

import re

from pyspark.sql import functions as F

from fernmill.llm import pii as P


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def slow(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if luhn(m[0])]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


CASES = [
    "a@b.com_x@c.org 1.2.3.4.5.6.7.8 999.1.1.1 +1 (22) 333-4444 4111 1111 1111 1111 \U0001f600 q@r.s. @x.y z@w",
    "4111-1111-1111-1111 4111  1111 1111 1111 5500000000000004 378282246310005 4111111111111111111",
    "+1+22 3456789012345 +1 2 3 4 5 6 7 8 - +(1) +12",
    "001.002.003.255 256.1.1.1 1.1.1.0000000255 01.1.1",
    "é@x.com a..b@c..d e@f.g.h+i@j.k é+1 (22) 333-4444",
    "x@y.z " * 300,
    "1 " * 300 + "4111 1111 1111 1111",
    "9" * 20_000,
    "+1 23456789. 4111 1111 1111 1112 4111111111111111x4111111111111111",
    "",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i long, text string")
    for r in df.select("i", P.base_spans(F.col("text")).alias("s")).collect():
        assert [(s.kind, s.start, s.end) for s in r.s] == slow(CASES[r.i]), r.i
        assert all(CASES[r.i][s.start : s.end] == s.value for s in r.s)


def test_long_runs_end_soon(spark):
    texts = ["a" * 200_000 + "@", "a.b" * 60_000 + "@x", "1.2" * 60_000, "+" * 100_000, "b@" + "a." * 60_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.select(F.size(P.base_spans(F.col("text"))).alias("n")).agg(F.count("n")).first()[0] == 5


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1500):
        got = spark.createDataFrame([(list(range(n)),)], "a array<int>").select(P.running(F.col("a")).alias("s")).first().s
        assert got == [i * (i - 1) // 2 for i in range(n)]


def corpus(spark):
    """Contacts introduced by the same words, one of them in an unknown form, and numbers in other contexts."""
    rows = [f"Some text here. Please reach me: user{i}@mail.example for more {i * 1111} items." for i in range(12)]
    rows += ["Before that, reach me: tel/555-0199x42 or come by.", "We sold 12345678 units of 98-7654-321 last year.", "the 10.0.0.1 of 10.0.0.2 in 10.0.0.3", "nothing at all"]
    rows += [f"the cat of day {i} went over the hill and of the sea" for i in range(200)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def found_in(docs, learned=None):
    return sorted((r.doc_id, s.value) for r in P.find(docs, patterns=learned).collect() for s in r.spans if s.kind == "found")


def test_contexts_discover_unseen_identifiers(spark):
    docs = corpus(spark)
    learned = P.learn(docs)
    kept = {r.pattern: r.confidence for r in learned.patterns.collect()}
    assert "<reach me:" in kept and "<the" not in kept and "<of" not in kept and all(c >= P.MIN_CONFIDENCE for c in kept.values())
    assert found_in(docs, learned) == [(12, "tel/555-0199x42")]


def test_found_instances_induce_patterns(spark):
    """Planted identifiers of four forms, most of them beyond the seeds' own contexts; recall and precision are measured."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("aeioubcdrstlmn", k=rng.randint(2, 7)))
    fill = lambda n: " ".join(word() for _ in range(n))
    handles = [f"{word()}_{word()}" for _ in range(40)]
    plates = [f"{word().upper()}-{word().upper()}" for _ in range(30)]
    ssns = [f"{rng.randint(100, 999)} {rng.randint(10, 99)} {rng.randint(1000, 9999)}" for _ in range(14)]
    rows, planted = [], set()

    def add(text, *values):
        planted.update((len(rows), v) for v in values)
        rows.append(text)

    for i in range(40):
        add(f"{fill(9)} contact tel:+1 555 {rng.randint(1000000, 9999999)} is what I use {fill(5)}")
        add(f"{fill(8)} {word()}{i}@{word()}.example is what I use {fill(6)}")
    for i, h in enumerate(handles):
        if i < 32:  # in a seed's right context, then in one of their own
            add(f"{fill(7)} {h} is what I use {fill(4)}", h)
        add(f"{fill(5)} posted by user {h}, {fill(6)}", h)  # induced by the first 32 handles
    for i, p in enumerate(plates):
        if i < 20:
            add(f"{fill(6)} contact tel:{p} {fill(6)}", p)
        add(f"{fill(6)} licence plate no. {p}; {fill(3)}", p)
    for i, s in enumerate(ssns):
        if i < 10:
            add(f"{fill(6)} posted by user {s}. {fill(6)}", s)  # the third step
        add(f"{fill(4)} ssn = {s} {fill(6)}", s)
    clean = [f"{fill(12)} by choice the contact is {rng.randint(1, 10**9)} of use {fill(12)}" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows + clean)), "doc_id long, text string")
    got = set(found_in(docs))
    assert len(planted) == 146 and len(got & planted) >= 0.9 * len(planted)
    assert len(got - planted) <= 0.02 * len(planted)


def test_copies_prove_nothing(spark):
    rows = [(i, "badge number 4111 1111 1111 1111 and badge number 77-8899-1") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not P.learn(docs).any and all(s.kind == "card" for r in P.find(docs).collect() for s in r.spans)


def test_mask(spark):
    texts = ["mail a@b.com now", "clean text 12", None, "", "+1 22 333 4444@x.com", "1.2.3.4 and a@b.c"]
    docs = spark.createDataFrame([(i, t, "keep", 9) for i, t in enumerate(texts)], "doc_id long, text string, base string, n_chars int")
    out = P.mask(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in range(6)] == ["mail [EMAIL] now", "clean text 12", None, "", "[PHONE]", "[IP] and [EMAIL]"]
    assert all(r.base == "keep" for r in got.values())
    assert not any(slow(r.text or "") for r in got.values())


def test_edge_rows(spark, edges, nothing):
    rows = P.find(edges.drop("base")).collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == slow(r.text or "")
    assert P.find(nothing).count() == 0
