"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Text and lexicon are folded alike: case, compatibility forms, homoglyphs of
other scripts, stacked marks, invisible characters and digit substitutions.
Accents stay, as they tell words apart. An entry is a word, or a stem written
``stem*`` that matches where a word begins; where several match, the longest
counts, a whole word before a stem. A match counts if it is whole and not part
of an exception phrase. The lexicon's weights and the calibration are
learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmill.llm.scratch import written

# Characters that stand in for a letter. "l" and "1" meet in "i",
# on the text's side and the lexicon's.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ӏ": "i", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "€": "e"}
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = [
    "clown fish", "clown car", "class clown", "rodeo clown", "trash can", "trash bin", "trash bag", "trash folder", "white trash compactor", "loser bracket", "losers bracket", "idiot proof", "idiots guide",
    "pond scum", "soap scum", "scum line", "garbage collector", "garbage collection", "garbage can", "sympathetic", "stupid simple", "keep it simple stupid", "worthless stock", "moron test",
]

#: Labelled rows that the lexicon and the calibration are fitted on, at most.
TRAIN_ROWS = 20_000
#: Letters of the longest stems; words are entries whatever their length.
STEM = 32
#: An entry's log odds at least.
MIN_GAIN = 2.0
#: Toxic rows that an entry needs, and the likelihood ratio (G squared) of its counts, at least: in a sample of no toxic
#: rows, and from ENOUGH of them on. Few rows prove little, and leaving out what they show costs more than it saves.
MIN_ROWS, MIN_G2, ENOUGH = (2, 3), (8.0, 12.0), 300
THRESHOLD = 0.7
#: Texts counted together.
PIECE = 256
SEED = 7

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {"l": "i"})
_INSIDE = re.compile(r"(?<=\w)[@$!€](?=\w)")
_DROPPED = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The form in which text and lexicon are compared."""
    text = text.lower()
    if not text.isascii():
        text = _DROPPED.sub("", unicodedata.normalize("NFKC", text))
    text = _INSIDE.sub(lambda m: SYMBOLS[m[0]], text)
    return text.translate(_FOLD)


def words(folded: str) -> list[str]:
    return _WORD.findall(folded)


@dataclass
class Model:
    """A lexicon of folded words with weights, and a logistic calibration of its features."""

    lexicon: dict[str, float]
    coef: list[float] = field(default_factory=lambda: [-3.0, 2.0, 0.0, 0.0])
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))

    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        known: dict[str, list[float | None]] = {}  # weights as a word and as a stem
        for entry, weight in self.lexicon.items():
            word = entry.removesuffix("*")
            known.setdefault(word, [None, None])[entry != word] = weight
        for word, weights in known.items():
            built.add_word(word, (len(word), *weights, False))
        for phrase in self.exceptions:
            folded = fold(phrase)
            if folded not in known:
                built.add_word(folded, (len(folded), None, None, True))
        if len(built):
            built.make_automaton()
        return built


def hits(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the lexicon's longest match at each word, outside exception phrases."""
    if not len(automaton):
        return []
    best, shields = {}, []
    for last, (size, whole, stem, shield) in automaton.iter(folded):
        start, end = last - size + 1, last + 1
        if start and folded[start - 1].isalpha():
            continue
        ended = end == len(folded) or not folded[end].isalpha()
        if shield and ended:
            shields.append((start, end))
        weight = whole if ended and whole is not None else stem
        if weight is not None:  # matches of one start come by length
            best[start] = (start, end, weight)
    spans = sorted(best.values())
    return [s for s in spans if not any(a <= s[0] and s[1] <= b for a, b in shields)] if shields else spans


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
    """Summed weight, weight for the square root of the length, and share of words hit."""
    folded = fold(text or "")
    found = hits(folded, automaton)
    if not found:
        return 0.0, 0.0, 0.0
    n = len(folded.split()) or 1
    total = sum(w for _, _, w in found)
    return math.log1p(max(0.0, total)), total / math.sqrt(n + 10), len(found) / n


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_features(x: np.ndarray, coef: list[float]) -> np.ndarray:
    return _sigmoid(coef[0] + x @ np.array(coef[1:]))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Logistic regression by Newton steps; weak ridge, so that it settles on any input."""
    a = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = _sigmoid(a @ w)
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _entries(text: str | None) -> set[str]:
    """The words of a text, and the stems they begin with."""
    own = {w for w in words(fold(text or "")) if len(w) >= 2}
    return own | {w[:k] + "*" for w in own for k in range(2, min(len(w), STEM) + 1)}


def _token_rows(wanted: frozenset[str] | None):
    """(token, n): in how many texts each entry stands; of the wanted ones only, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PIECE):
                counts: Counter[str] = Counter()
                for text in batch.column(0).slice(at, PIECE):
                    own = _entries(text.as_py())
                    counts.update(own if wanted is None else own & wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return run


def _counted(rows: DataFrame, least: int, wanted: frozenset[str] | None = None) -> dict[str, int]:
    """Texts that hold each entry, if at least so many; bounded by the sample's words."""
    found = rows.select("text").mapInArrow(_token_rows(wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in found.where(F.col("n") >= least).collect()}


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = TRAIN_ROWS) -> Model:
    """Fit lexicon and calibration on at most ``max_rows`` labelled rows, chosen by a seeded hash.

    ``labels`` (doc_id, toxic 0/1) should leave out what is to be held out. Rows
    with a null id or label are not used; an id labelled twice counts as its
    largest label, and one of several documents with its text of the smallest hash. Words and stems are weighed by how much more often toxic rows
    have them, and kept while the likelihood ratio is significant, all of them: the
    lexicon grows with the sample only. Null texts count as empty. Without
    labelled rows the lexicon is empty and every score equally low.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).dropna()
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_rows)
    # The sample has at most max_rows rows of an id and a label, so it can be broadcast.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-train")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad:
        return Model({}, [-3.0, 0.0, 0.0, 0.0])
    known_part = min(1.0, bad / ENOUGH)
    least_rows, least_g2 = (lo + round((hi - lo) * known_part, 6) for lo, hi in (MIN_ROWS, MIN_G2))
    # Only what enough toxic rows have can be an entry, so only that is looked for in the others.
    toxic = _counted(rows.where("toxic = 1"), math.ceil(least_rows - 0.5))
    others = _counted(rows.where("toxic = 0"), 1, frozenset(toxic))
    share, lexicon = bad / (bad + good), {}
    for token, t in sorted(toxic.items()):
        c = others.get(token, 0)
        gain = math.log(((t + 0.5) / (bad + 1)) / ((c + 0.5) / (good + 1)))
        g2 = 2 * (t * math.log(t / (share * (t + c))) + (c * math.log(c / ((1 - share) * (t + c))) if c else 0.0))
        if gain > MIN_GAIN and g2 > least_g2:
            lexicon[token] = round(gain, 4)
    model = Model(lexicon)
    fitted = rows.mapInArrow(_feature_rows(model), "f1 double, f2 double, f3 double, toxic int").toPandas()  # max_rows rows at most
    model.coef = _calibrate(fitted[["f1", "f2", "f3"]].to_numpy(), (fitted["toxic"] == 1).to_numpy().astype(float))
    return model


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([features(t.as_py(), automaton) for t in batch.column(0)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), batch.column(1)], names=["f1", "f2", "f3", "toxic"])

    return run


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic; null and empty texts, and those without an entry, score alike and low. Texts that repeat score the same."""

    @F.pandas_udf("double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        for texts in parts:
            x = np.array([features(t, automaton) for t in texts], float).reshape(-1, 3)
            yield pd.Series(score_features(x, model.coef))

    return udf(text)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: CRC-32 of the id's digits leaves 1 when divided by 3; null ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def to_json(model: Model) -> str:
    return json.dumps({"lexicon": model.lexicon, "coef": model.coef, "exceptions": model.exceptions}, ensure_ascii=False)


def from_json(text: str) -> Model:
    return Model(**json.loads(text))
