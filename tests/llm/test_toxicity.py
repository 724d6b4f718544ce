"""Toxicity: folding, exceptions, stems, and held-out accuracy on the generated labels."""

import random

import pytest
from pyspark.sql import functions as F

from fernmill.llm import toxicity as X

MODEL = X.Model({"idiot": 5.0, "trash": 4.0, "réeux*": 3.0}, [-4.0, 2.0, 2.0, 0.0])


def found(text):
    folded = X.fold(text)
    return [folded[a:b] for a, b, _ in X.hits(folded, MODEL.automaton())]


def test_matches_survive_disguise():
    for text in ("you idiot", "IDIOT!", "1d10t", "ìdiot idіot", "i​diot", "ID̶IOT", "idiot's", "id!ot"):
        assert "idiot" in found(text), text
    assert found("idiotic idiots midiot") == []
    assert found("réeuxment reeuxment arréeux") == ["réeux"]


def test_exception_phrases():
    assert found("take out the trash can") == [] and found("this is trash") == ["trash"] and found("trash can trash") == ["trash"]


def test_length_counts():
    auto = MODEL.automaton()
    short, long = X.features("you idiot", auto), X.features("you idiot " + "word " * 2000, auto)
    assert short[0] == long[0] and short[1] > long[1] and short[2] > long[2]
    assert X.features(None, auto) == X.features("", auto) == (0.0, 0.0, 0.0)
    assert X.from_json(X.to_json(MODEL)) == MODEL


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.85), ("sf0.1", 0.92)])
def test_held_out_accuracy(spark, sf, recall):
    """At sf0.01 there are 33 toxic rows to learn from and 18 held out, of which one shares no word with them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels.where(~X.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", X.score(F.col("text"), model).alias("s")).join(labels.where(X.held_out(F.col("doc_id"))), "doc_id").select("s", "toxic").toPandas()
    hit = rows.s >= X.THRESHOLD
    assert hit[rows.toxic == 1].mean() >= recall and hit[rows.toxic == 0].mean() <= 0.005
    assert rows.s.between(0, 1).all()


def test_held_out_rows(spark):
    import zlib

    got = spark.range(50).select("id", X.held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(r.id).encode()) % 3 == 1 for r in got]


def test_edge_rows(spark, edges, nothing):
    rows = edges.select(X.score(F.col("text"), MODEL).alias("s")).collect()
    assert len(rows) == edges.count() and all(0 <= r.s < 0.5 for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(edges, none)
    assert model.lexicon == {} and edges.select(F.max(X.score(F.col("text"), model))).first()[0] < 0.5
    assert nothing.select(X.score(F.col("text"), MODEL)).count() == 0
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    assert X.train(edges, some).lexicon == {}


def test_scores_equal_a_plain_matcher():
    """Every entry tried at every place, longest first, against Aho-Corasick."""
    rng = random.Random(2)
    letters = "aiors"
    lexicon = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) + rng.choice(["", "", "*"]): float(i % 7 + 1) for i in range(60)}
    model = X.Model(lexicon, exceptions=["ra so", "is air"])
    auto = model.automaton()

    def slow(text):
        out, shields = [], []
        ended = lambda e: e == len(text) or not text[e].isalpha()
        for at in range(len(text)):
            if at and text[at - 1].isalpha():
                continue
            best = None
            for entry, weight in lexicon.items():
                word, stem = entry.removesuffix("*"), entry.endswith("*")
                if text.startswith(word, at) and (stem or ended(at + len(word))):
                    best = max(best or (0, False, 0.0), (len(word), not stem, weight))
            if best:
                out.append((at, at + best[0], best[2]))
            shields += [(at, at + len(p)) for p in map(X.fold, model.exceptions) if text.startswith(p, at) and ended(at + len(p))]
        return [x for x in out if not any(a <= x[0] and x[1] <= b for a, b in shields)]

    for _ in range(400):
        text = X.fold("".join(rng.choice(letters + "  .") for _ in range(60)))
        assert X.hits(text, auto) == slow(text)
