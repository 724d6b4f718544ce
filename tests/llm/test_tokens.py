"""Token counts: offsets against decoding token by token, every rule against a plain loop."""

import random

import numpy as np
import pytest

from fernmill.llm import tokens as K

ENCODER = K.Encoder(open(K.VOCABULARY, "rb").read())
TEXTS = ["", "Hello world\n\nsecond  line", "é\U0001f600 中文 text\n", "a\r\n b\n \n c", "word " * 500 + "\n" + "x" * 1000]


def slow(text, bounds, rule):
    """Allocate by walking over bytes."""
    counts, crossed, at = [0.0] * (len(bounds) - 1), [0] * (len(bounds) - 1), 0
    section = lambda b: max(i for i in range(len(bounds) - 1) if bounds[i] <= b)
    for token in ENCODER.encoding.encode_ordinary(text):
        size = len(ENCODER.encoding.decode_single_token_bytes(token))
        per = {}
        for b in range(at, at + size):
            per[section(b)] = per.get(section(b), 0) + 1
        keys = sorted(per)
        for k in keys[1:]:
            crossed[k] += 1
        if rule == "split":
            for k in keys:
                counts[k] += per[k] / size
        else:
            counts[{"start": keys[0], "end": keys[-1], "largest": max(keys, key=lambda k: (per[k], -k))}[rule]] += 1
        at += size
    return counts, crossed


@pytest.mark.parametrize("rule", K.RULES)
def test_allocation(rule):
    rng = random.Random(4)
    for text in TEXTS[1:]:
        size = len(text.encode())
        bounds = np.array([0, *sorted(rng.sample(range(1, size), min(6, size - 1))), size])
        counts, crossed = K.allocate(ENCODER.ends(text), bounds, rule)
        want, cross = slow(text, bounds.tolist(), rule)
        assert np.allclose(counts, want) and crossed.tolist() == cross
        assert round(counts.sum(), 6) == len(ENCODER.encoding.encode_ordinary(text))


def test_offsets_cover_the_text():
    for text in TEXTS:
        ends = ENCODER.ends(text)
        assert (ends[-1] if len(ends) else 0) == len(text.encode())
    raw = np.frombuffer("é\U0001f600a".encode(), np.uint8)
    assert K.byte_offsets(raw, np.array([0, 1, 2, 3, 9])).tolist() == [0, 2, 6, 7, 7]


def test_sections_by_line(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in K.section_tokens(df).collect():
        text = TEXTS[r.doc_id]
        assert len(r.tokens) == text.count("\n") + 1 and sum(r.tokens) == r.n_tokens == len(ENCODER.encoding.encode_ordinary(text)) and r.n_chars == len(text)


def test_given_sections_and_fields(spark):
    df = spark.createDataFrame([(1, "été abc def", [0, 4]), (2, "abc", [1]), (3, "abc", []), (4, "abc", None), (5, None, [0])], "doc_id long, text string, starts array<int>")
    got = {r.doc_id: r.tokens for r in K.section_tokens(df, starts="starts").collect()}
    assert sum(got[1]) == len(ENCODER.encoding.encode_ordinary("été abc def")) and len(got[1]) == 2 and got[3] == [] and got[4] == [] and got[5] == [0.0]
    rows = spark.createDataFrame([(1, "Title", "body text", None)], "doc_id long, title string, body string, note string")
    one = K.field_tokens(rows, ["title", "body", "note"]).first()
    assert one.tokens_title + one.tokens_body + one.tokens_note == one.n_tokens and one.tokens_note == 0
    with pytest.raises(ValueError, match="rule"):
        K.section_tokens(rows, text="title", rule="none")


def test_edge_rows(spark, edges, nothing):
    rows = K.section_tokens(edges).collect()
    assert len(rows) == edges.count() and all(sum(r.tokens) == r.n_tokens for r in rows)
    assert K.section_tokens(nothing).count() == 0


def test_ids_keep_their_type(spark):
    rows = spark.createDataFrame([("a-1", "one two\nthree"), (None, None)], "doc_id string, text string")
    found = K.section_tokens(rows)
    assert dict(found.dtypes)["doc_id"] == "string" and sorted((r.doc_id or "", r.n_chars) for r in found.collect()) == [("", 0), ("a-1", 13)]
    assert K.field_tokens(rows, ["text"]).columns == ["doc_id", "n_tokens", "tokens_text"]
