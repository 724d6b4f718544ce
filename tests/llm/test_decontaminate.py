"""Decontamination: exact, disguised and re-parameterised items; the index against all windows."""

import random

from fernmill.llm import decontaminate as D

ITEM = "If Tom has 12 apples and gives 5 apples to Mary, how many apples does Tom have left at the end of day?"
INDEX = D.build_index([(1, ITEM)])


def coverage(text, index=INDEX):
    found = D.matches(text, index, D.Reader())
    return {i: (n / of, exact) for i, n, of, exact in found}


def test_exact_whatever_the_case():
    assert coverage("bla " + ITEM + " bla")[1] == (1.0, True)
    assert coverage(ITEM.upper())[1] == (1.0, True)
    assert coverage(ITEM.replace(" ", "\n  "))[1][0] == 1.0


def test_other_numbers_and_names():
    asked = ITEM.replace("Tom", "Anna").replace("Mary", "Lucy").replace("12", "31").replace("5 ", "7 ")
    found, exact = coverage("Here: " + asked)[1]
    assert found >= 0.9 and not exact


def test_slots_must_agree():
    asked = ITEM.replace("If Tom", "If Anna").replace("does Tom", "does Bob").replace("12", "31")
    assert coverage(asked)[1][0] < coverage(ITEM.replace("Tom", "Anna").replace("12", "31"))[1][0]


NAMED = "Alice has 12 apples. Bob has 5 more apples than Alice. Carol gives 3 apples to Bob. How many apples does Carol have?"
ASKED = "Dora has 31 apples. Emil has 7 more apples than Dora. Frida gives 9 apples to Emil. How many apples does Frida have?"


def test_names_that_open_sentences():
    index = D.build_index([(1, NAMED)])
    found, exact = coverage("Some words before. " + ASKED, index)[1]
    assert found == 1.0 and not exact
    assert coverage(NAMED, index)[1] == (1.0, True)
    # Slots must still agree: nobody is asked about twice here.
    mixed = ASKED.replace("than Dora", "than Gina").replace("to Emil", "to Hugo").replace("does Frida", "does Ida")
    assert coverage(mixed, index).get(1, (0, 0))[0] < found


def test_names_whatever_the_case_and_slots_of_several_words():
    index = D.build_index([(1, NAMED)])
    assert coverage(ASKED.lower(), index)[1][0] >= 0.5
    assert coverage(ASKED.upper(), index)[1][0] >= 0.5
    longer = ASKED.replace("Emil", "Mary Ann").replace("31", "thirty one").replace("Frida", "Jean Luc Moreau")
    assert coverage(longer, index)[1][0] == 1.0
    assert D.matches("Every tree has many leaves. People have more leaves than trees. The wind gives leaves to people. How many does it have?", index, D.Reader()) == []


def reported(text, item):
    return bool(D.found(text, D.build_index([(1, item)]), D.Reader()))


def test_partial_and_edited_items_are_reported():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59)]
    for n, run in ((38, 22), (59, 32), (59, 13)):
        text = "some other words " + " ".join(words[9 : 9 + run]) + " and then more"
        assert reported(text, " ".join(words[:n]))
    assert not reported("before " + " ".join(words[9:21]) + " after", " ".join(words[:38]))  # 12 words
    for n in range(11, 23):  # one changed word, wherever it is
        for at in range(n):
            edited = words[:at] + ["changed"] + words[at + 1 : n]
            assert reported("before " + " ".join(edited) + " after", " ".join(words[:n])), (n, at)
    edited = list(words[:38])
    edited[12] = edited[25] = "changed"
    assert reported(" ".join(edited), " ".join(words[:38]))
    assert not reported("none " + " ".join(words[i] for i in range(38) if i % 3), " ".join(words[:38]))


def test_windows_without_a_template_do_not_count():
    item = "we walked 3 km 4 min 5 kg 6 m 7 s 8 g 9 cm 10 mm to find the whole sum of it all"
    asked = "we walked 23 km 24 min 25 kg 26 m 27 s 28 g 29 cm 30 mm to find the whole sum of it all"
    assert reported(asked, item)
    assert not reported("to find a sum of the whole list we added it", item)


def test_clean_texts_stay():
    rng = random.Random(1)
    words = "the of and to in is it that was for on are with he as his they at be this from".split()
    for _ in range(50):
        assert coverage(" ".join(rng.choices(words, k=400))) == {}
    names = " ".join(f"Bob has {i} Alice" for i in range(50))
    assert coverage(names) == {}  # a template of placeholders proves nothing


def test_windows_are_found_as_by_comparing_all():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 14)))) for i in range(30)]
    index = D.build_index(items)
    for _ in range(30):
        text = rng.choices(vocabulary, k=60)
        chosen = rng.choice(items)[1].split()
        text[20:20] = chosen
        got = {i: n for i, n, _, _ in D.matches(" ".join(text), index, D.Reader())}
        want = {}
        for i, item in items:
            w = item.split()
            size = min(D.WINDOW, len(w))
            if len(w) >= D.MIN_ITEM:  # a shorter one would have to stand alone
                windows = {tuple(text[k : k + size]) for k in range(len(text) - size + 1)}
                n = sum(tuple(w[k : k + size]) in windows for k in range(len(w) - size + 1))
                if n:
                    want[i] = n
        assert got == want


def test_pairs(spark, edges):
    benchmark = spark.createDataFrame([(1, ITEM), (2, "quick brown fox jumps over the lazy dog near the river"), (3, None), (4, ""), (5, "one"), (None, "w0x0 w1x1 w2x2 w3x3 w4x4")], "item_id long, text string")
    want = {(1, 2), (7, None), (5, 5)}
    for together in (500, 1):
        D.TOGETHER = together
        rows = D.contaminated(edges, benchmark).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == 4
        kept = D.clean(edges, benchmark)
        assert kept.columns == edges.columns and kept.count() == edges.count() - 4
    D.TOGETHER = 500


def test_empty_tables(spark, edges, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.contaminated(edges, none).count() == 0 and D.clean(edges, none).count() == edges.count()
    assert D.contaminated(nothing, some).count() == 0 and D.clean(nothing, some).count() == 0


def test_planted_items_are_found(spark):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    squeeze = lambda t: " ".join(t.lower().split())
    items = {r.item_id: squeeze(r.text) for r in benchmark.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in squeeze(r.text)}
    assert want and want <= {(r.doc_id, r.item_id) for r in D.contaminated(docs, benchmark).collect()}


def test_slots_are_one_to_one_over_all_diagonals():
    whole = coverage(ITEM.replace("Tom", "Anna").replace("12", "31"))[1][0]
    assert coverage(ITEM.replace("Mary", "Tom").replace("12", "5"))[1][0] < whole  # two values became one
    far = ITEM.replace("5 apples to Mary,", "5 apples to Mary Ann,").replace("does Tom", "does Zoe").replace("12", "31")
    assert coverage(far)[1][0] < coverage(far.replace("does Zoe", "does Tom"))[1][0]


def test_short_items_stand_alone():
    assert reported("First line.\nYes, maybe.\nLast line", "Yes maybe") and reported("yes maybe", "Yes maybe")
    assert not reported("They said yes maybe to it.", "Yes maybe")


def brute(text, item):
    """Windows of an item found by comparing all windows word by word, slots bound one to one over one diagonal."""
    import re

    def read(t):
        words, first = [], True
        for w in re.findall(r"\d+|[A-Za-z]+|[.!?\n]", t):
            if w in ".!?\n":
                first = True
                continue
            slot = "n" if w.isdigit() else "N" if w[0].isupper() and not w.isupper() and not first else None
            words.append((w.lower(), slot))
            first = False
        return words

    a, b, held = read(item), read(text), set()
    for offset in range(-len(a), len(b)):
        pairs = [(a[i], b[i + offset]) if 0 <= i + offset < len(b) else None for i in range(len(a))]
        alike = [p is not None and (p[0][0] == p[1][0] or p[0][1] is not None and p[0][1] == p[1][1]) for p in pairs]
        starts = [s for s in range(len(a) - 7) if all(alike[s : s + 8])]
        plain = [s for s in starts if all(p[0][0] == p[1][0] for p in pairs[s : s + 8])]
        shaped = [s for s in starts if sum(p[0][1] is None for p in pairs[s : s + 8]) >= 3 and all(p[0][1] == p[1][1] for p in pairs[s : s + 8])]
        starts = sorted({*plain, *shaped})
        bound = [(pairs[i][0][0], pairs[i][1][0]) for i in sorted({s + k for s in starts for k in range(8)}) if pairs[i][0][1]]
        if len({x for x, _ in bound}) == len(set(bound)) == len({y for _, y in bound}):
            held |= set(starts)
        elif bound:
            return None  # a vote decides
        else:
            held |= set(starts)
    return held


def test_template_windows_are_found_as_by_comparing_all():
    rng = random.Random(8)
    names, fill = ["Tom", "Ann", "Zed", "Kim", "Lou", "Max"], ["has", "and", "gives", "to", "of", "the", "red", "cups", "more", "than"]
    item = lambda: " ".join(rng.choice([rng.choice(fill), rng.choice(fill), rng.choice(fill), rng.choice(names), str(rng.randint(1, 60))]) for _ in range(rng.randint(9, 24)))
    checked = 0
    for _ in range(300):
        own = "so " + item()
        other = {**dict(zip(names, rng.sample(["Eva", "Ian", "Uma", "Bob", "Pam", "Joe"], 6))), **{str(i): str(i + 100) for i in range(61)}}
        text = " ".join(rng.choices(fill, k=6)) + " " + " ".join(other.get(w, w) for w in own.split()) + " " + " ".join(rng.choices(fill, k=6))
        want = brute(text, own)
        if want is None:
            continue
        index = D.build_index([(1, own)])
        index.folded, index.seeds = {}, {}
        index.close()
        got = {n for _, n, _, _ in D.matches(text, index, D.Reader())}
        assert got == ({len(want)} if want else set()), (own, text)
        checked += bool(want)
    assert checked > 100


def test_recall_on_questions_asked_again(spark):
    """Benchmark items with a question's numbers and names put in, asked again with others, within other text."""
    rng = random.Random(12)
    people, others = ["Tom", "Mary", "Alice", "Bob"], ["Hugo", "Gina", "Mary Ann", "Emil", "Frida"]
    rows, docs = [], []
    for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(120).collect():
        words = r.text.split()
        if len(words) < 16:
            continue
        spots = rng.sample(range(1, len(words)), max(2, len(words) // 9))
        old = [rng.choice(people) if k % 2 else str(rng.randint(2, 99)) for k in range(len(spots))]
        swap = dict(zip(people, rng.sample(others, 4))) | {str(i): str(i * 7 + 100) for i in range(100)}
        mine, theirs = list(words), list(words)
        for at, x in zip(spots, old):
            mine[at], theirs[at] = mine[at] + " " + x, theirs[at] + " " + swap[x]
        rows.append((len(rows), " ".join(mine)))
        docs.append((len(docs), " ".join(rng.choices(words, k=30)) + ". " + " ".join(theirs)))
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"))
    pairs = {(r.doc_id, r.item_id) for r in found.collect()}
    hit = sum((i, i) in pairs for i, _ in rows)
    assert len(rows) >= 40 and hit >= 0.9 * len(rows) and len(pairs) <= hit + 0.02 * len(rows)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", ITEM)], "doc_id string, text string")
    items = spark.createDataFrame([("x", ITEM), ("y", ITEM)], "item_id string, text string")
    assert {(r.doc_id, r.item_id, r.exact) for r in D.contaminated(docs, items).collect()} == {("a", "x", True), ("a", "y", True)}
