"""Archives: an exact round trip, revisits, and damage."""

import base64
import gzip
import hashlib
import io

import pytest
from helpers import DATA, duck_rows, spark_rows

from fernmill.llm import warc as W
from fernmill.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [(3, "http://a/ x", "<p>é</p>", "p"), (1, "http://b", "<p>é</p>", "p"), (2, None, "", "p"), (4, "u", None, "p"), (5, "u\r\nX: y", "z" * 3_000_000, "p"), (None, "n", "q", "p"), (6, "u", "q", "p"), (7, "u", "once", "p"), (7, "u", "once", "p")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = W.round_trip(spark.createDataFrame(ROWS, SCHEMA), roll_bytes=200).collect()
    assert len(got) == len(ROWS)
    want = {(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "revisit", 2), (5, "response", None), (None, "revisit", 6), (6, "response", None), (7, "response", None), (7, "revisit", 7)}
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == want
    texts = {i: t or "" for i, _, t, _ in ROWS}
    for r in got:
        assert r.payload_bytes == len(texts[r.page_id].encode()) and r.payload_digest == digest(texts[r.page_id])
        assert r.payload == (texts[r.page_id].encode() if r.record_type == "response" else None)


def test_matches_duckdb(spark):
    assert spark_rows(QUERIES["op4_warc"](spark, str(DATA))) == duck_rows(W.SQL)


def test_small_payloads_stay_responses(spark):
    got = W.round_trip(spark.createDataFrame(ROWS, SCHEMA), min_revisit_bytes=100, payloads=False).collect()
    assert {r.record_type for r in got} == {"response"} and all(r.payload is None for r in got)


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_format():
    raw = W.make_record(1, "http://a", b"body") + W.make_record(2, "http://b", b"body", 1)
    text = gzip.decompress(raw).decode()  # members one after another are one gzip file
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Type: revisit" in text and text.count("Content-Length: 4\r\n") == 2
    assert [(h["warc-type"], p) for h, _, p in W.read_records(io.BytesIO(raw))] == [("response", b"body"), ("revisit", b"")]


class Trickle(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7) if n > 0 else 7)


def test_reads_in_small_pieces():
    raw = b"".join(W.make_record(i, "u", bytes([i]) * 5000) for i in range(5))
    assert [len(p) for _, _, p in W.read_records(Trickle(raw))] == [5000] * 5


def rewrite(raw, old, new):
    return gzip.compress(gzip.decompress(raw).replace(old, new))


@pytest.mark.parametrize(
    "damage",
    [
        lambda raw: raw[:-5],
        lambda raw: raw[: len(raw) // 2],
        lambda raw: rewrite(raw, b"body", b"bodY"),
        lambda raw: rewrite(raw, b"Content-Length: 4", b"Content-Length: 5"),
        lambda raw: rewrite(raw, b"\r\n\r\n", b"\n"),
        lambda raw: rewrite(raw, b"WARC/1.1", b"HTTP/1.1"),
        lambda raw: raw + b"junk",
    ],
)
def test_damage_is_found(damage):
    with pytest.raises(W.WarcError):
        list(W.read_records(io.BytesIO(damage(W.make_record(1, "u", b"body")))))


def test_repeated_pages_and_null_urls(spark):
    rows = [(7, "u", "once"), (7, "u", "once"), (7, None, "once"), (7, "a", "once"), (9, "v", "once"), (7, "x", "other"), (8, None, "w")]
    got = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.url or "", r.record_type, r.refers_to or 0) for r in got) == [
        (7, "", "response", 0), (7, "a", "revisit", 7), (7, "u", "revisit", 7), (7, "u", "revisit", 7), (7, "x", "response", 0), (8, "", "response", 0), (9, "v", "revisit", 7),
    ]
    assert sum(r.url is None for r in got) == 2


def test_ids_of_other_types(spark):
    got = W.round_trip(spark.createDataFrame([("b é\n", "u", "x"), ("a", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {("b é\n", "revisit", "a"), ("a", "response", None), (None, "response", None)}
