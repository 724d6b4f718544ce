"""Licence scans against DuckDB, and against every start tried by hand."""

import random
import re
from collections import Counter

from helpers import DATA, duck_rows, plain, spark_rows
from pyspark.sql import functions as F

from fernmill.llm import licenses as L
from fernmill.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow(texts):
    """By text: words, phrase places, labels and score, trying each template at each word."""
    notices = [L.template(*x) for x in L.TEMPLATES]
    words = L.vocabulary(notices)
    read = [WORD.findall(lowered(t)) for t in texts]
    held = Counter(w for ws in read for w in set(ws))
    order = sorted(words, key=lambda w: (held[w], w))
    out = []
    for ws in read:
        own = set([w for w in order if w in ws][: L.LOOKED_UP])
        base = sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
        labels, best = {label for _, label in base}, 0.0
        for x in notices:
            index = set([w for w in order if w in x.words][: L.INDEXED])
            for at in range(-len(x.words) + 1, len(ws)):
                fits = [p for p, w in enumerate(x.words) if 0 <= at + p < len(ws) and ws[at + p] == w]
                if sum(x.words[p] in own & index for p in fits) >= L.MIN_AGREED and set(x.phrase) <= set(fits):
                    best = max(best, len(fits) / len(x.words))
                    if 100 * len(fits) >= int(100 * L.MIN_SHARE) * len(x.words):
                        labels.add(x.label)
        out.append((len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best))
    return out


def got(spark, texts):
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in rows]


def test_matches_duckdb(spark):
    assert spark_rows(QUERIES["op13_licenses"](spark, str(DATA))) == duck_rows(SQL["op13_licenses"])


def test_edge_rows(spark, edges, nothing):
    found = L.scan(edges)
    rows = edges.select("text").collect()
    want = Counter(tuple(plain(v) for v in x) for x in slow([r.text for r in rows]))
    assert Counter(tuple(plain(v) for v in tuple(r)[1:]) for r in found.collect()) == want
    assert L.scan(nothing).count() == 0
    clash = nothing.select(*nothing.columns, F.lit(1).alias("hits"), F.lit(1).alias("found"))
    assert L.scan(clash).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_equals_every_start_tried(spark):
    rng = random.Random(4)
    filler = "the of and license licenses public mit general apache work under any use software is in été 中文 foo".split()
    texts = [None, "", "MIT License", "mit license", "MİT LICENSE mit-LICENSE", "looK mit license", "General Public  License; general public license"]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [rng.choice(filler) for _ in range(rng.randrange(12))]
            own = rng.choice(L.TEMPLATES)[2].split()
            cut = rng.randrange(len(own)) if rng.random() < 0.3 else 0
            words += [rng.choice(filler) if rng.random() < 0.1 else w.upper() if rng.random() < 0.2 else w for w in own[cut:]]
        texts.append(" ".join(words))
    assert got(spark, texts) == slow(texts)


def test_notices_are_found_and_prose_is_not(spark):
    notices = [x[2] for x in L.TEMPLATES]
    found = got(spark, ["Some words before. " + x + " And some after." for x in notices] + ["Permission was hereby granted to use the public software.", "He is free to use any license of the public."])
    for (label, _, _), row in zip(L.TEMPLATES, found, strict=False):
        assert label in row[5].split(",") and row[6] == 1.0
    assert [r[5:] for r in found[-2:]] == [("", 0.0)] * 2


def test_long_texts(spark):
    many = "Released under the MIT License. " * 8_000
    words = "license " * 60_000
    (first, second) = got(spark, [many, words])
    assert first == (40_000, 8_000, 3, 39_998, "mit", "mit", 1.0) and second[:2] == (60_000, 0)
