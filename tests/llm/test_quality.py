"""Line-first quality rules against DuckDB and against a plain count."""

import re
from collections import Counter

from helpers import DATA, duck_rows, spark_rows
from pyspark.sql import functions as F

from fernmill.llm import quality as Q
from fernmill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_matches_duckdb(spark):
    assert spark_rows(QUERIES["op5_quality"](spark, str(DATA))) == duck_rows(Q.SQL)


def test_measures_on_edge_rows(spark, edges, nothing):
    got = Q.measure(edges).collect()
    assert len(got) == edges.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(r.text)
        assert r.kept is False or not r.base_failed
    assert Q.measure(nothing).count() == 0


def test_repeats_overlap(spark):
    texts = ["a b c a b c", "x x x x", "a b c d e f g h", "a b", "", "a b c q a b c q b c q"]
    rows = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    assert [r.n_repeat_words for r in Q.measure(rows).orderBy("doc_id").collect()] == [slow(t)[4] for t in texts]


def test_verdict(spark):
    good = "\n".join(" ".join(f"{w}{chr(97 + i)}{chr(97 + j)}" for j, w in enumerate("Some plain words that make up one readable sentence".split())) + "." for i in range(12))
    menu = "\n".join(f"Home{i} | News{i} | About{i} | Contact{i} | Shop{i} | Login{i}" for i in range(12))
    noise = " ".join(f"word{i}###" for i in range(80)) + "."
    rows = spark.createDataFrame([(1, good), (2, menu), (3, noise), (4, good + "\nAll rights reserved."), (5, good + "\n" + menu)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in Q.measure(rows).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert {r.doc_id: r.text for r in Q.clean(rows).collect()} == {1: good, 4: good}
    assert rows.where("doc_id = 5").select(Q.cleaned(F.col("text")).alias("t")).first().t == good


def test_agrees_with_quality_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = Q.measure(docs).where("NOT base_failed").join(labels, "doc_id")
    assert judged.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0] >= 0.98
