"""Secret scanning: fixed patterns, and a character network over every candidate.

The network is a small convolutional one in numpy. It sees a candidate whole,
with the characters around it, and is trained here on labelled findings that a
seeded generator writes: credentials in the forms in use, and the identifiers,
checksums, paths and words that resemble them or stand near the same keywords.
On findings it was not trained on, its threshold lets hardly any plain one pass,
but is lowered as far as the wanted recall demands. It scores the fixed
patterns' spans too, which stay whatever it says.

A candidate is a run of six or more characters without white space, quotes,
brackets and the signs that separate names from values. Words of letters in
plain case are candidates only where a keyword stands before them: alone, no
reader could tell a password from a word.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 24 or more is the whole run, so asking for the length at once finds the same.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "network"]
#: Runs the network may be asked about, what is cut off their ends, and keywords that make words candidates too.
RUN = re.compile(r"""[^\s"'`<>(){}\[\],;:=@]{6,}={0,2}""")
STOPS, OPENINGS = ".!?*&%$#|\\~…", "*&%|\\~"
KEYWORD = re.compile(r"pass|pwd|\bpin\b|secret|token|key|auth|bearer|credential|private|login", re.IGNORECASE)

CONTEXT = 24
#: Candidates that are encoded and scored together.
PIECE = 4_096
RECALL = 0.95
SEED = 11
FILTERS, WIDTH, EMBED, HIDDEN = 40, 5, 8, 24
#: Characters of one convolved piece; longer candidates are pooled over several.
PIECE = 256

_ALPHABET = string.ascii_letters + string.digits + "+/_=-.:\"' \n@#$%&*()[]{}<>,;!?|\\"
_CODES = np.full(128, len(_ALPHABET) + 1, np.int64)
_CODES[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)
VOCABULARY = len(_ALPHABET) + 2


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns' matches, leftmost and non-overlapping by kind."""
    lower = text.lower()
    # Plain searches first: most texts name no credential at all.
    named = any(word in lower for word in ("passw", "secret", "token", "key"))
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if named else []
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_by_start)


def _by_start(span: tuple) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


def candidates(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Spans of the network's candidates that lie within no span in ``taken``."""
    found: list[tuple[int, int]] = []
    keywords = [m.end() for m in KEYWORD.finditer(text)]
    begins = [s for s, _, _ in taken]  # in order
    reach = list(accumulate((e for _, _, e in taken), max))
    for m in RUN.finditer(text):
        run = m[0].rstrip(STOPS)
        end = m.start() + len(run)
        run = run.lstrip(OPENINGS)
        if len(run) < 6:
            continue
        start = end - len(run)
        if run.isalpha() and (run[1:].islower() or run.isupper()):
            at = bisect_right(keywords, start)
            if not at or keywords[at - 1] < start - CONTEXT:
                continue
        before = bisect_right(begins, start)
        if not before or reach[before - 1] < end:
            found.append((start, end))
    return found


def _encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes and roles (before, inside, after) of a candidate in context, two rows."""
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    points = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _CODES[np.minimum(points, 127)], VOCABULARY - 1)
    roles = np.ones(len(codes), np.int64)
    roles[: start - lo] = 0
    roles[end - lo :] = 2
    return np.stack([codes, roles])


@dataclass
class Network:
    """Embedding, convolution, max pooling, a hidden layer and a logistic unit, with its calibrated threshold."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def _rows(self, codes: np.ndarray, roles: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.embed[codes], np.eye(3)[roles]], axis=-1)
        return x * (codes > 0)[..., None]

    def _windows(self, x: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(x.shape[0], x.shape[1] - WIDTH + 1, -1)

    def pooled(self, codes: np.ndarray, roles: np.ndarray) -> np.ndarray:
        """Largest response of each filter; rows of ``codes`` are zero-padded."""
        return np.maximum(self._windows(self._rows(codes, roles)) @ self.filters + self.bias, 0).max(axis=1)

    def probability(self, spans: list[np.ndarray]) -> np.ndarray:
        """Calibrated probability that each encoded candidate is a secret."""
        if not spans:
            return np.empty(0)
        pieces, owner = [], []
        for i, x in enumerate(spans):
            for at in range(0, max(1, x.shape[1] - WIDTH + 1), PIECE - WIDTH + 1):
                pieces.append(x[:, at : at + PIECE])
                owner.append(i)
        best = np.zeros((len(spans), FILTERS))
        for at in range(0, len(pieces), 512):
            part = pieces[at : at + 512]
            codes, roles = _pad(part)
            np.maximum.at(best, owner[at : at + 512], self.pooled(codes, roles))
        z = np.maximum(best @ self.hidden[:-1] + self.hidden[-1], 0) @ self.out[:-1] + self.out[-1]
        return _sigmoid(self.scale[0] * z + self.scale[1])


def _pad(spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    width = max(WIDTH, *(x.shape[1] for x in spans)) if len(spans) > 1 else max(WIDTH, spans[0].shape[1])
    both = np.zeros((2, len(spans), width), np.int64)
    for i, x in enumerate(spans):
        both[:, i, : x.shape[1]] = x
    return both[0], both[1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_findings(n: int, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """``n`` findings (text, start, end, label), half of them secrets, by a seeded generator."""
    rng = random.Random(seed)
    pick = lambda chars, lo, hi: "".join(rng.choices(chars, k=rng.randint(lo, hi)))
    mixed, marks = string.ascii_letters + string.digits, "!#$%&*+-_/.?^~"
    syllables = "the ing on er ti an re ha ou le es ment que cion ver ge ich en sh ly ma po ra do si ku bo lin ter fa wo".split()
    vowels, consonants = "aeiouaeiouyäéöü", "bcdfghjklmnprstvwzßñ"
    spoken = lambda k: "".join(rng.choice(consonants) + rng.choice(vowels) + rng.choice(["", "", "n", "r", "st", "ck"]) for _ in range(k))
    word = lambda lo=1, hi=4: "".join(rng.choices(syllables, k=rng.randint(lo, hi))) if rng.random() < 0.6 else spoken(rng.randint(max(1, lo - 1), hi))
    cased = lambda x: "".join(c.upper() if rng.random() < 0.4 else c for c in x)
    digit = lambda lo, hi: str(rng.randint(lo, hi))
    leet = str.maketrans("aeiost", "431057")

    tokens = [
        lambda: rng.choice(["ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "npm_", "AIza", "SG.", "pk-", "sk-", "ya29.", "dop_v1_"]) + pick(mixed + "-_", 20, 48),
        lambda: pick(mixed, 20, 64), lambda: pick(mixed + "+/", 30, 62) + "=" * rng.randint(0, 2), lambda: pick(mixed + "-_", 24, 48), lambda: "eyJ" + pick(mixed + "-_", 20, 60) + "." + pick(mixed + "-_", 20, 90) + "." + pick(mixed + "-_", 20, 50),
        lambda: pick(string.ascii_letters, 24, 48), lambda: "-".join(pick(mixed, 5, 8) for _ in range(rng.randint(3, 5))),
    ]
    passwords = [
        lambda: pick(mixed + marks, 8, 18) + rng.choice(string.digits), lambda: word(2, 3).translate(leet) + digit(0, 999), lambda: cased(word(3, 6)), lambda: word(1, 3) + digit(1, 9999) + word(1, 3) + rng.choice(["", "!", "#1"]) + rng.choice(mixed),
        lambda: "-".join(word(1, 2) for _ in range(rng.randint(3, 5))) + digit(0, 99), lambda: pick(mixed, 8, 14), lambda: word(2, 3).capitalize() + rng.choice("!#$%&*_") + digit(1, 2030),
    ]
    plain = [
        lambda: "-".join(pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: "-".join(word() for _ in range(rng.randint(2, 6))) + rng.choice(["", "-" + digit(1, 2030)]), lambda: f"{word()}_{word()}_{word()}" + rng.choice(["", "_" + digit(0, 99)]),
        lambda: "/".join(["", *(word() for _ in range(rng.randint(2, 5)))]) + rng.choice(["", "/" + digit(1, 99999), ".html", ".py"]), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(["", "T" + digit(10, 23)]), lambda: word(2, 4) + digit(1, 999),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 4))) + rng.choice(["", digit(1, 99)]), lambda: word().upper() + "-" + digit(1000, 99999) + rng.choice(["", "-" + word().upper()]), lambda: digit(10**5, 10**15), lambda: ".".join(digit(0, 255) for _ in range(4)),
        lambda: "-".join(pick(string.digits, 2, 5) for _ in range(4)), lambda: "v" + ".".join(digit(0, 30) for _ in range(3)) + rng.choice(["", "-" + word()]), lambda: "//www." + word(2) + "." + rng.choice(["com", "org", "example"]) + "/" + "/".join(word() for _ in range(rng.randint(0, 4))),
        lambda: word(2).capitalize() + rng.choice(["'s", "-" + word(), "." + word().capitalize(), "/" + word()]), lambda: word(2, 4) + rng.choice(["***", "!!", "%%%", "..."]) + word(1, 3), lambda: digit(1, 999) + "," + digit(100, 999) + "." + digit(10, 99), lambda: "camel" + word().capitalize() + word().capitalize(),
        lambda: "+" + digit(1, 99) + "-" + digit(100, 999) + "-" + digit(1000, 9999), lambda: "#" + word(2), lambda: word(2, 4) + ".example.org", lambda: word(3, 5).upper() + rng.choice(["!!", "-", "."]) + word(2).upper(), lambda: word(1, 2).capitalize()[:1].upper() * 2 + word(2, 3),
        lambda: digit(10**15, 10**17), lambda: digit(200, 999) + "-" + digit(1000, 9999), lambda: word(2, 3) + "." + digit(0, 99), lambda: word(2, 3) + "." + word(2), lambda: "//www." + word(2, 3) + ".com/" + "/".join("-".join(word() for _ in range(rng.randint(1, 3))) for _ in range(3)) + rng.choice(["", "-" + digit(1, 99)]) + ".html", lambda: "mail" + digit(1, 99) + ".example.com", lambda: rng.choice(["DB", "API", "MY", "AWS", "USER"]) + "_" + rng.choice(["PASS", "KEY", "TOKEN", "SECRET", "NAME"]), lambda: word().upper()[:2] + word(2, 3), lambda: word(1, 2) + "." + word(1, 1) + "/" + word(1, 2),
        lambda: rng.choice("456") + digit(10**14, 10**15 - 1), lambda: ".".join(digit(1, 255) for _ in range(4)), lambda: digit(100, 999) + "-" + digit(1000, 9999), lambda: word(1, 3) + "." + digit(10, 99), lambda: word(2, 4).capitalize() + word(1, 3).capitalize(), lambda: "-".join(word(1, 3) for _ in range(3)), lambda: "_".join(word(1, 3) for _ in range(2)) + "_" + digit(1, 9), lambda: pick("0123456789abcdef", 7, 20),
    ]
    words_only = [lambda: word(3, 5), lambda: word(2, 4).capitalize(), lambda: rng.choice("required expired should needed manager changed policy reset already number stored between always please without cannot".split())]
    strong = ["key=", "Authorization: Bearer ", "auth: ", "export API_KEY=", "credential ", '"private": "', "X-Auth-Token: ", "secret key ", "access token is ", "api key ", "token "]
    weak = ["password is ", "export DB_PASS ", "pin: ", "passwd ", "login with ", "pwd=", "user:", "the passphrase is ", "my password: ", "PGPASSWORD=", "private password ", "pass "]
    neutral = ["id: ", "see ", "commit ", "path=", "version ", '"name": "', "order ", "file ", "at ", "the ", "ref ", "class ", "call ", "on ", "branch ", "+1 (555) ", "https:", "card ", "server "]
    bland = ["the key to ", "token of ", "a login page ", "key: ", "password ", "your password ", "the secret of ", "private ", "by key ", "pass the ", "auth "]

    found = []
    for i in range(n):
        label = i % 2
        if label and rng.random() < 0.55:
            value, cue = rng.choice(tokens)(), rng.choice(strong + weak + neutral + [""] * 8)
        elif label:
            value, cue = rng.choice(passwords)(), rng.choice(weak + strong)
        elif rng.random() < 0.25:
            value, cue = rng.choice(words_only)(), rng.choice(bland + weak)
        else:
            value, cue = rng.choice(plain)(), rng.choice(neutral * 2 + bland + [""] * 12)
        lead = " ".join(word() for _ in range(rng.randint(0, 5))) + rng.choice([" ", "\n", ". ", ' "', " | "]) + cue
        tail = rng.choice([" ", "\n", '" ', ", ", ". ", "@", "### ", "&&& "]) + " ".join(word() for _ in range(4))
        found.append((lead + value + tail, len(lead), len(lead) + len(value), label))
    return found


def _fit(spans: list[np.ndarray], y: np.ndarray, epochs: int, rng: np.random.Generator) -> Network:
    inside = WIDTH * (EMBED + 3)
    net = Network(rng.normal(0, 0.3, (VOCABULARY, EMBED)), rng.normal(0, (2 / inside) ** 0.5, (inside, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, (FILTERS + 1, HIDDEN)), rng.normal(0, 0.3, HIDDEN + 1))
    parts = [net.embed, net.filters, net.bias, net.hidden, net.out]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(spans)), 0.006 * (1 - epoch / epochs) ** 1.5
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            codes, roles = _pad([spans[i] for i in own])
            windows = net._windows(net._rows(codes, roles))
            response = windows @ net.filters + net.bias
            where = response.argmax(axis=1)
            best = np.maximum(np.take_along_axis(response, where[:, None], 1)[:, 0], 0)
            felt = np.maximum(best @ net.hidden[:-1] + net.hidden[-1], 0)
            error = (_sigmoid(felt @ net.out[:-1] + net.out[-1]) - y[own]) / len(own)
            d_out = np.append(felt.T @ error, error.sum())
            d_felt = error[:, None] * net.out[:-1] * (felt > 0)
            d_hidden = np.vstack([best.T @ d_felt, d_felt.sum(0)])
            d_best = d_felt @ net.hidden[:-1].T * (best > 0)
            picked = np.take_along_axis(windows, where[:, :, None], 1)
            d_filters = np.einsum("bfi,bf->if", picked, d_best)
            d_rows = (d_best[:, :, None] * net.filters.T).reshape(len(own), FILTERS, WIDTH, EMBED + 3)[..., :EMBED]
            d_embed = np.zeros_like(net.embed)
            at_codes = np.take_along_axis(codes[:, None].repeat(FILTERS, 1), where[:, :, None] + np.arange(WIDTH), 2)
            np.add.at(d_embed, at_codes, d_rows * (at_codes > 0)[..., None])
            step += 1
            for p, g, m, v in zip(parts, (d_embed, d_filters, d_best.sum(0), d_hidden, d_out), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, w = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(a @ w)
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


@lru_cache(maxsize=4)
def train(n: int = 20000, epochs: int = 6, recall: float = RECALL, passed: float = 0.001, seed: int = SEED) -> Network:
    """A network fitted on two thirds of ``n`` generated findings; the rest calibrate it.

    The threshold passes at most ``passed`` of the calibrating plain findings
    (and is one half at least), unless ``recall`` of the secrets need a lower one.
    """
    findings = labelled_findings(n, seed)
    spans, y = [_encode(t, s, e) for t, s, e, _ in findings], np.array([x[3] for x in findings], float)
    cut = 2 * n // 3
    net = _fit(spans[:cut], y[:cut], epochs, np.random.default_rng(seed))
    held = net.probability(spans[cut:])
    net.scale = _platt(np.log(held / (1 - held)), y[cut:])
    held, secret = net.probability(spans[cut:]), y[cut:] == 1
    strict = max(0.5, float(np.quantile(held[~secret], 1 - passed)))
    net.threshold = min(strict, float(np.quantile(held[secret], 1 - recall)))
    return net


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def found(texts: list[str], net: Network) -> list[list[tuple[int, str, int, float]]]:
    """Spans (start, kind, end, score) of each text by start, then kind: all base spans, and what the network finds."""
    base = [base_spans(t) for t in texts]
    asked = [(i, s, k, e) for i, t in enumerate(texts) for s, k, e in [*base[i], *((s, "network", e) for s, e in candidates(t, base[i]))]]
    out: list[list] = [[] for _ in texts]
    for at in range(0, len(asked), PIECE):
        part = asked[at : at + PIECE]
        scores = net.probability([_encode(texts[i], s, e) for i, s, _, e in part])
        for (i, s, k, e), p in zip(part, scores.tolist(), strict=True):
            if k != "network" or p >= net.threshold:
                out[i].append((s, k, e, p))
    return [sorted(x, key=_by_start) for x in out]


def find(text: str | None, net: Network) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and the network's spans of one text."""
    every = [x[:3] for x in found([text or ""], net)[0]]
    return [x for x in every if x[1] != "network"], [x for x in every if x[1] == "network"]


FINDINGS = "n_assign long, n_access long, n_hex long, n_network long, base_sha256 string, spans array<struct<kind:string,start:int,end:int,score:double>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", net: Network | None = None) -> DataFrame:
    """One row per row of ``docs``: counts by kind, the base spans' digest, all spans.

    Offsets count code points, ends are exclusive; spans are ordered by start,
    then kind, each with the network's score. The base patterns' spans always
    stay; the network adds spans that lie within none of them. Null texts count as empty, null ids stay null,
    repeated rows and empty tables give as many rows as they have; other columns
    are ignored.
    """
    net = net or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            rows = found(texts, net)
            digests = [hashlib.sha256(_joined([x[:3] for x in row if x[1] != "network"]).encode()).hexdigest() for row in rows]
            spans = [[{"kind": k, "start": s, "end": e, "score": p} for s, k, e, p in row] for row in rows]
            count = lambda kind: pa.array([sum(x["kind"] == kind for x in row) for row in spans], pa.int64())
            struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(count(k) for k in KINDS), pa.array(digests), pa.array(spans, struct)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FINDINGS}")


def joined(spans) -> F.Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
