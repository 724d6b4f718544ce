"""The corpus pipeline: every stage against a plain version, written here, over what it was given."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from fernmill.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of each stage, written as Parquet and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, stages):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, copies, leaks, private, mixed = stages
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert all(df.columns == first.columns for df in stages[:-1])

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic_ones = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean_ones = {r.doc_id for r in labels.where("toxic = 0").collect()}
    bad = set(rows(first)) - set(rows(toxic))
    assert len(bad & toxic_ones) >= 0.6 * len(toxic_ones & set(rows(first))) and len(bad & clean_ones) <= 0.01 * len(clean_ones)
    model = toxicity.train(first, labels.where(~toxicity.held_out(F.col("doc_id"))))
    assert bad == {i for i, r in rows(first).items() if slow_score(r.text, model) >= toxicity.THRESHOLD}

    given = {i: shingles(r.text) for i, r in rows(toxic).items()}
    group = {i: i for i in given}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    holding = {}
    for i in sorted(given):  # all pairs that share a shingle
        shared = {}
        for g in given[i]:
            for j in holding.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            holding[g].append(i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(given[i]) + len(given[j]) - n):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    assert set(rows(copies)) == {find(i) for i in given}

    items = [plain_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: " ".join(plain_words(r.text)) for i, r in rows(copies).items()}
    whole = {i for i, t in texts.items() if any(f" {' '.join(w)} " in f" {t} " for w in items if len(w) >= 8)}
    windows = {" ".join(w[k : k + 5]) for w in items for k in range(len(w) - 4)}
    near = {i for i, t in texts.items() if any(" ".join(t.split()[k : k + 5]) in windows for k in range(len(t.split()) - 4))}
    gone = set(texts) - set(rows(leaks))
    assert whole and whole <= gone <= near

    after, before = rows(private), rows(leaks)
    assert set(after) == set(before)
    for i, r in before.items():
        assert after[i].n_chars == len(after[i].text)
        for kind, pattern in PERSONAL:
            assert not re.search(pattern, after[i].text), (i, kind)
        if not re.search("[0-9@]", r.text):
            assert after[i].text == r.text
    assert any(after[i].text != r.text for i, r in before.items())

    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in after.items()}
    totals, taken = {}, {}
    for i, r in after.items():
        totals[r.source] = totals.get(r.source, 0) + sizes[i]
    goal, left, weight = {}, 1.5 * sum(totals.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(totals))}
    while weight:  # whoever would get over twice its size gets that, the rest is shared again
        full = [s for s, w in weight.items() if w * left / sum(weight.values()) > 2 * totals[s]]
        if not full:
            goal |= {s: w * left / sum(weight.values()) for s, w in weight.items()}
            break
        for s in full:
            goal[s] = 2 * totals[s]
            del weight[s]
        left = 1.5 * sum(totals.values()) - sum(goal.values())
    for i, r in rows(mixed).items():
        assert r.text == after[i].text and r.copies in (1, 2) and r.size == sizes[i] and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in goal.items():
        assert abs(taken.get(s, 0) - t) <= max(sizes[i] for i, r in after.items() if r.source == s) / 2 + 1


PERSONAL = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("phone", r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}")]


def plain_words(text):
    return [w.lower() for w in re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_][^\W_]*(?:['’][^\W\d_]+)*", text or "")]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_clashing_columns(spark, tmp_path):
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    clash = "size copies taken members fp key grams row bands best times kept base spans id _id _key _held n h p root".split()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).selectExpr("*", *(f"'x' as {c}" for c in clash))
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns if k < 4 else sorted(out.columns) == sorted(docs.columns)
        assert all(r.members == "x" for r in out.collect())
        docs = out


def test_run_is_the_stages(spark, stages):
    assert {i: r.copies for i, r in rows(C.run(spark, SF)).items()} == {i: r.copies for i, r in rows(stages[-1]).items()}


def test_edge_rows_pass_every_stage(spark, edges, nothing, tmp_path):
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    for start in (edges, nothing):
        docs = start
        for _, stage in C.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.collect()
        if start is nothing:
            assert docs.count() == 0


def slow_score(text, model):
    """A model's score by trying every entry at every word, without an automaton."""
    import math

    folded = toxicity.fold(text or "")
    shields = [(m.start(), m.end()) for x in model.exceptions for m in re.finditer(r"(?<![^\W\d_])" + re.escape(toxicity.fold(x)) + r"(?![^\W\d_])", folded)]
    weights = []
    for m in re.finditer(r"[^\W\d_]+", folded):
        word = m[0]
        best = model.lexicon.get(word)
        size = len(word)
        if best is None:
            size = next((k for k in range(len(word), 0, -1) if word[:k] + "*" in model.lexicon), 0)
            best = model.lexicon.get(word[:size] + "*")
        if best is not None and not any(a <= m.start() and m.start() + size <= b for a, b in shields):
            weights.append(best)
    n, total = len(folded.split()) or 1, sum(weights)
    x = (math.log1p(max(0.0, total)), total / math.sqrt(n + 10), len(weights) / n) if weights else (0.0, 0.0, 0.0)
    return 1 / (1 + math.exp(-(model.coef[0] + sum(a * b for a, b in zip(model.coef[1:], x)))))
