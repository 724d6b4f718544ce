"""Token counts by section, from one encoding of each whole document.

A document is encoded once. Its tokens' byte spans follow from the vocabulary's
byte lengths, and an interval join on the sorted spans (a binary search) gives
each token to the sections it touches. Tokens that cross a boundary are
allocated by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary's text is split before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: start: all of a token to the section of its first character. end: of its last.
#: largest: to the section with most of its bytes, the earlier one of equals.
#: split: to each section in proportion to its bytes.
RULES = ("start", "end", "largest", "split")


class Encoder:
    """A byte-level vocabulary; ships as its file's bytes and is built once in each worker."""

    _built: dict[int, Encoder] = {}

    def __init__(self, ranks: bytes) -> None:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("fernmill", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)

    @classmethod
    def of(cls, ranks: bytes) -> Encoder:
        key = hash(ranks)
        if key not in cls._built:
            cls._built = {key: cls(ranks)}
        return cls._built[key]

    def ends(self, text: str) -> np.ndarray:
        """Byte offset of each token's end."""
        if not text:
            return np.empty(0, np.int64)
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


def byte_offsets(raw: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Byte offsets of code point offsets; the text's end for one at or past its length."""
    firsts = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.append(firsts, len(raw))[np.clip(chars, 0, len(firsts))]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens of it that cross its start) for sections from bound to bound.

    ``bounds`` are n + 1 ascending byte offsets of n sections that follow one
    another. An empty section gets nothing.
    """
    n = len(bounds) - 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    inside = (last >= 0) & (first < n)
    starts, ends, first, last = starts[inside], ends[inside], np.maximum(first[inside], 0), np.minimum(last[inside], n - 1)
    crossing = np.flatnonzero(last > first)
    crossed = np.zeros(n, np.int64)
    for i in crossing.tolist():
        crossed[first[i] + 1 : last[i] + 1] += 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossed
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float), crossed
    whole = last == first
    counts = np.bincount(first[whole], minlength=n).astype(float)
    for i in crossing.tolist():
        k = np.arange(first[i], last[i] + 1)
        parts = np.minimum(bounds[k + 1], ends[i]) - np.maximum(bounds[k], starts[i])
        if rule == "largest":
            counts[k[parts.argmax()]] += 1
        elif rule == "split":
            counts[k] += parts / (ends[i] - starts[i])
        else:
            raise ValueError(f"rule must be one of {RULES}")
    return counts, crossed


SECTIONS = "n_chars long, n_tokens long, tokens array<double>, crossed array<long>"


def _counter(ranks: bytes, rule: str, by_line: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for batch in batches:
            rows = []
            starts = [None] * batch.num_rows if by_line else batch.column(2).to_pylist()
            for value, own in zip(batch.column(1), starts, strict=True):
                text = value.as_py() or ""
                raw = np.frombuffer(text.encode(), np.uint8)
                if by_line:
                    cuts = np.flatnonzero(raw == 10) + 1
                    cuts = np.concatenate(([0], cuts))
                else:
                    cuts = byte_offsets(raw, np.array(sorted(x for x in own or [] if x is not None), np.int64))
                ends = encoder.ends(text)
                counts, crossed = allocate(ends, np.append(cuts, len(raw)), rule) if len(cuts) else (np.empty(0), np.empty(0, np.int64))
                rows.append((len(text), len(ends), counts, crossed))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_chars", "n_tokens", "tokens", "crossed"])

    return run


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", starts: str | None = None, rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, n_chars, n_tokens, tokens, crossed), one for each row of ``docs``.

    Sections are the text's lines, or begin at the code point offsets in the
    array column ``starts`` and reach to the next one or the end (what stands
    before the first belongs to none). ``tokens`` has each section's tokens by
    ``rule``, ``crossed`` those that began before it and reach into it. The
    vocabulary is read by the driver and shipped. A null text is an empty one,
    of one empty section; a null or empty ``starts`` gives no sections; ids keep
    their type, null ones stay null; repeated rows stay; an empty table gives no
    rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    columns = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    if starts:
        columns.append(F.col(starts).cast("array<long>").alias("starts"))
    rows = docs.select(*columns)
    return rows.mapInArrow(_counter(ranks, rule, starts is None), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SECTIONS}")


def field_tokens(docs: DataFrame, fields: list[str], doc_id: str = "doc_id", separator: str = "\n", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, n_tokens, one column of tokens for each field) of the fields' joined text.

    The fields are joined by ``separator`` and encoded as one text; a separator
    belongs to the field before it. Null fields are empty.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    start, starts = F.lit(0), []
    for p in parts:
        starts.append(start)
        start = start + F.length(p) + len(separator)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.concat_ws(separator, *parts).alias("text"), F.array(*starts).alias("starts"))
    counted = section_tokens(rows, starts="starts", rule=rule, vocabulary=vocabulary)
    return counted.select("doc_id", "n_tokens", *(F.get("tokens", i).alias(f"tokens_{f}") for i, f in enumerate(fields)))
