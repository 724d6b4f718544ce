"""Benchmark decontamination by canonical templates.

Numbers, units and names become typed placeholders, and the windows of what is
left are hashed, for benchmark items a table, for documents a stream that one
scan makes and a Bloom filter of the items' windows thins out. The two are
joined by hash. Every pair of a text and an item that share a window is then
compared whole: matches are laid along diagonals (document position less item
position) and checked word by word, and each value of the item's slots must
become one value of the document's, no two the same one, over all diagonals. So
a question asked again with other numbers or names is caught, and chance
matches of templates are not. Plain lower-case windows are joined as well: there
a copy matches whatever its case. A folded form goes with them: there a run of
one placeholder is one slot, capitalised words are names where sentences open
too, and a document's words that no item has as plain words are names whatever
their case, as they could match nothing else.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmill.llm.scratch import few, written

WINDOW = 8
#: Shorter items prove nothing in running text and are looked for where they stand alone as a sentence or line.
MIN_ITEM = 4
#: Plain words that a template window needs at least.
MIN_LITERAL = 3
#: Share of an item's windows that a document must hold.
MIN_COVERAGE = 0.5
#: Plain words of an item in one consistent run that are reported whatever the coverage.
MIN_RUN = 13
#: Share of an item's words, and of its plain words, that agree on a diagonal when single edits break its windows.
MIN_AGREED = 0.8
#: Items that one edit can leave without a window, by words, and the shorter seeds they are looked for by.
SHORT_ITEM, SEED_WINDOW = range(11, 17), 5
#: Bits of the Bloom filters: 16 a window, between these powers of two, so that at most 64 MB are broadcast.
BLOOM = (22, 29)
#: Bytes of texts hashed together.
PIECE = 1 << 19
#: Items compared with a text at once.
TOGETHER = 500

# Words that count as numbers or units.
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = set("mm cm m km inch inches foot feet ft yard yards mile miles g kg mg lb lbs pound pounds ounce ounces oz ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit kmh mph volt volts watt watts".split())

TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_][^\W_]*(?:['’][^\W\d_]+)*|[.!?…\n]")
_NUM, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest(x, 1)) for x in ("<number>", "<unit>", "<name>"))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_END, _CAP, _NUMBER, _UNIT_WORD = 1, 2, 4, 8
#: Words remembered by a worker before it starts anew.
_REMEMBERED = 300_000


class _Known(dict):
    """Numbers of tokens; a new one is learned when it is asked for."""

    def __init__(self, learn) -> None:
        self.learn = learn

    def __missing__(self, token: str) -> int:
        return self.learn(token)


class Reader:
    """Turns texts into arrays of words: plain identities, template identities, slots."""

    def __init__(self) -> None:
        self.known = _Known(self._learn)
        self.ids = np.empty(_REMEMBERED, np.uint64)
        self.flags = np.empty(_REMEMBERED, np.int8)

    def _learn(self, token: str) -> int:
        lower = token.lower()
        flag = _END if token in ".!?…\n" else _NUMBER if token[0].isdigit() or lower in NUMBER_WORDS else _UNIT_WORD if lower in UNITS else 0
        if not flag and token[0].isupper() and not token.isupper():
            flag = _CAP
        at = self.known[token] = len(self.known)
        if at >= len(self.ids):
            self.ids, self.flags = (np.resize(x, 2 * at) for x in (self.ids, self.flags))
        self.ids[at], self.flags[at] = xxhash.xxh64_intdigest(lower), flag
        return at

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(plain, template, slot): slot marks where the template has a placeholder."""
        return self.read_all(text)[:3]

    def read_all(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``read`` gives, with where sentences begin and which words are capitalised."""
        return self.read_many([text])[:5]

    def read_many(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """The arrays of ``read_all`` for texts one after another, and each word's text."""
        if len(self.known) > _REMEMBERED:
            self.known = _Known(self._learn)
        parts = [TOKEN.findall(text or "") for text in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        flags, plain, of = self.flags[at], self.ids[at], np.repeat(np.arange(len(parts)), sizes)
        opens = np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1]))
        ends = flags == _END
        first = opens.copy()
        first[1:] |= ends[:-1]
        number, unit, cap = flags == _NUMBER, flags == _UNIT_WORD, flags == _CAP
        name = cap & ~first
        unit[1:] &= number[:-1]  # a unit follows its number
        unit &= ~opens
        template = plain.copy()
        template[number], template[unit], template[name] = _NUM, _UNIT, _NAME
        words = ~ends
        return plain[words], template[words], (number | unit | name)[words], first[words], cap[words], of[words]


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` identities; none if there are fewer."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = ids[:n].copy()
    for k in range(1, size):
        out *= _MULTIPLIER
        out += ids[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _literal(slot: np.ndarray, size: int) -> np.ndarray:
    """Which windows of a template have enough plain words."""
    sums = np.concatenate(([0], np.cumsum(~slot)))
    return sums[size:] - sums[:-size] >= min(MIN_LITERAL, size)


def fold(plain: np.ndarray, template: np.ndarray, slot: np.ndarray, first: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, template, slot, starts) with ``names`` as slots too and runs of a placeholder within a sentence as one.

    A word that opens a sentence and a run ("If Tom") belongs to the name only if it is one elsewhere.
    """
    names = names & ~slot
    if names.any():
        template, slot = np.where(names, _NAME, template), slot | names
    goes_on = slot[1:] & (template[1:] == template[:-1]) & ~first[1:]
    if not goes_on.any():
        return plain, template, slot, np.arange(len(plain))
    starts = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    opens = np.flatnonzero(first[:-1] & goes_on & (template[:-1] == _NAME))
    if len(opens):
        sure = np.isin(plain[opens], plain[(template == _NAME) & ~first])
        plain = plain.copy()
        plain[opens[~sure]] = 0
    return np.add.reduceat(plain, starts), template[starts], slot[starts], starts


class Bloom:
    """A set of hashes as bits, two for each: may hold more than was put in, never less."""

    def __init__(self, power: int) -> None:
        self.power, self.bits = power, np.zeros(1 << (power - 3), np.uint8)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes >> np.uint64(64 - self.power), (hashes * _MULTIPLIER) >> np.uint64(64 - self.power)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _test(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Where the set may hold a hash; the second bit is looked up only where the first is set."""
        found = np.flatnonzero(self._test(hashes >> np.uint64(64 - self.power)))
        return found[self._test((hashes[found] * _MULTIPLIER) >> np.uint64(64 - self.power)).astype(bool)] if len(found) else found

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        out[self.hits(hashes)] = True
        return out


def salted(hashes: np.ndarray, form: int) -> np.ndarray:
    """Hashes of windows of a size (or of the folded form or the seeds), kept apart from those of others."""
    return (hashes ^ np.uint64(form)) * np.uint64(0xD6E8FEB86659FD93)


_FOLDED, _SEEDS, _WORDS = 101, 102, 103


@dataclass
class Index:
    """Windows of benchmark items by size and hash."""

    items: dict[int, tuple[object, int, int, np.ndarray, np.ndarray]] = field(default_factory=dict)  # row: item, window, windows, plain, slots
    sizes: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    folds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # row, values, slots, starts and the end
    folded: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    shapes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # row: template, which windows are indexed by template
    seeds: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # plain words of folded items, sorted

    def close(self) -> Index:
        for form, table in ((_FOLDED, self.folded), (_SEEDS, self.seeds), *self.sizes.items()):
            self.keys[form] = np.sort(np.fromiter(table, np.uint64, len(table)))
        return self

    def known(self, form: int, hashes: np.ndarray) -> list[int]:
        """Where ``hashes`` are windows of the form."""
        keys = self.keys[form]
        if not len(keys):
            return []
        return np.flatnonzero(keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes).tolist()

    def windows(self) -> np.ndarray:
        """All windows, salted by their form."""
        return np.concatenate([np.empty(0, np.uint64), *(salted(keys, form) for form, keys in self.keys.items())])

    def unknown(self, plain: np.ndarray) -> np.ndarray:
        """Which words no folded item has as plain words."""
        if not len(self.words):
            return np.ones(len(plain), bool)
        return self.words[np.minimum(np.searchsorted(self.words, plain), len(self.words) - 1)] != plain


def build_index(items: list[tuple[object, str | None]], words: np.ndarray | None = None) -> Index:
    """The windows of items; ``words``, sorted, stand in for the items' own plain words."""
    index, reader = Index(), Reader()
    literals: set[int] = set()
    for row, (item_id, text) in enumerate(items):
        plain, template, slot, first, cap = reader.read_all(text)
        if not len(plain):
            continue
        size = min(WINDOW, len(plain))
        own = index.sizes.setdefault(size, {})
        index.items[row] = (item_id, size, len(plain) - size + 1, plain, slot)
        solid = _literal(slot, size)
        for at, (a, b) in enumerate(zip(window_hashes(plain, size).tolist(), window_hashes(template, size).tolist(), strict=True)):
            own.setdefault(a, []).append((row, at))
            if solid[at] and a != b:
                own.setdefault(b, []).append((row, at))
        by_shape = solid.copy()
        if len(plain) in SHORT_ITEM:
            for at, a in enumerate(window_hashes(plain, SEED_WINDOW).tolist()):
                index.seeds.setdefault(a, []).append((row, at))
        for names in (cap, np.zeros(len(cap), bool)) if (cap & ~slot).any() else (cap,):
            values, shape, slots, starts = fold(plain, template, slot, first, names)
            if len(values) < WINDOW or not slots.any():
                continue
            literals.update(plain[~(slot | cap)].tolist())
            for at in np.flatnonzero(_literal(slots, WINDOW)).tolist():
                index.folded.setdefault(int(window_hashes(shape[at : at + WINDOW], WINDOW)[0]), []).append((len(index.folds), at))
                by_shape[starts[at] : np.append(starts, len(plain))[at + WINDOW] - size + 1] = True
            index.folds.append((row, values, slots, np.append(starts, len(plain))))
        index.shapes[row] = template, by_shape
    index.words = np.array(sorted(literals), np.uint64) if words is None else words
    return index.close()


def _binding(item: np.ndarray, doc: np.ndarray, covered: list[tuple[int, int]]) -> dict[int, int]:
    """What each value in an item's slots became, by the most places (item, document); no two became the same."""
    votes = Counter((int(item[p]), int(doc[q])) for p, q in covered)
    binding: dict[int, int] = {}
    taken: set[int] = set()
    for (own, other), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0][0] != x[0][1], x[0])):
        if own not in binding and other not in taken:
            binding[own] = other
            taken.add(other)
    return binding


def _consistent(item: np.ndarray, slots: np.ndarray, doc: np.ndarray, size: int, found: dict[int, list[int]]) -> dict[int, list[int]]:
    """Of the windows matched on each diagonal, those whose slots agree with one binding for all."""
    at = {offset: sorted({s + k for s in starts for k in range(size) if slots[s + k]}) for offset, starts in found.items()}
    covered = [(p, p + offset) for offset, places in at.items() for p in places]
    if not covered:
        return found
    binding = _binding(item, doc, covered)
    out = {}
    for offset, starts in found.items():
        wrong = {p for p in at[offset] if binding.get(int(item[p])) != int(doc[p + offset])}
        out[offset] = [s for s in starts if wrong.isdisjoint(range(s, s + size))] if wrong else starts
    return out


def _match_folded(plain: np.ndarray, template: np.ndarray, slot: np.ndarray, first: np.ndarray, names: np.ndarray, index: Index, best: dict[int, tuple[set[int], bool]]) -> None:
    """Add to ``best`` the windows of items that a text holds in its folded form, ``names`` being slots too."""
    names = names & ~slot
    shape = template.copy()
    shape[names] = _NAME
    goes_on = (shape[1:] == shape[:-1]) & (slot | names)[1:] & ~first[1:]
    hashes = window_hashes(shape[np.concatenate(([True], ~goes_on))], WINDOW)
    hits = index.known(_FOLDED, hashes)
    if not hits:
        return
    values, template, _, _ = fold(plain, template, slot, first, names)
    found: dict[int, dict[int, set[int]]] = {}
    for at in hits:
        for k, start in index.folded[int(hashes[at])]:
            found.setdefault(k, {}).setdefault(at - start, set()).add(start)
    for k, diagonals in found.items():
        row, item, slots, edges = index.folds[k]
        size = index.items[row][1]
        literal = ~slots
        # Word by word: what is plain in the item's window is the same in the text.
        ranged = {o: [s for s in sorted(starts) if (item[s : s + WINDOW] == values[s + o : s + o + WINDOW])[literal[s : s + WINDOW]].all()] for o, starts in diagonals.items()}
        good = _consistent(item, slots, values, WINDOW, ranged)
        # A folded window holds all plain ones between its ends.
        more = {p for starts in good.values() for s in starts for p in range(edges[s], edges[s + WINDOW] - size + 1)}
        held, same = best.get(row, (set(), True))
        best[row] = (held | more, same and more <= held)


def _run(starts: list[int], size: int, literal: np.ndarray) -> int:
    """Most plain words in a run of matched windows that overlap or touch."""
    best = at = 0
    while at < len(starts):
        last = at
        while last + 1 < len(starts) and starts[last + 1] <= starts[last] + size:
            last += 1
        best = max(best, int(literal[starts[at] : starts[last] + size].sum()))
        at = last + 1
    return best


def _agrees(item: np.ndarray, shape: np.ndarray, slots: np.ndarray, plain: np.ndarray, template: np.ndarray, offset: int) -> bool:
    """Whether a document has most of an item's words on a diagonal, edited words aside."""
    lo, hi = max(0, -offset), min(len(item), len(plain) - offset)
    same = np.zeros(len(item), bool)
    same[lo:hi] = (item[lo:hi] == plain[lo + offset : hi + offset]) | (slots[lo:hi] & (shape[lo:hi] == template[lo + offset : hi + offset]))
    if same.sum() < MIN_AGREED * len(item) or same[~slots].sum() < MIN_AGREED * (~slots).sum():
        return False
    held = np.flatnonzero(same & slots).tolist()
    good = len(_consistent(item, slots, plain, 1, {offset: held})[offset])
    return same.sum() - len(held) + good >= MIN_AGREED * len(item)


def text_windows(plain: np.ndarray, template: np.ndarray, slot: np.ndarray, first: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(size, hashes, whether of plain words) of a text's windows."""
    for size in sizes:
        if len(plain) >= size:
            yield size, window_hashes(plain, size), True
            if slot.any():  # else the template is the text
                yield size, window_hashes(template, size), False


def _alone(first: np.ndarray, at: int, size: int) -> bool:
    """Whether a window is a whole sentence or line."""
    return bool(first[at]) and (at + size == len(first) or bool(first[at + size])) and not first[at + 1 : at + size].any()


def _looked_up(text: str | None, index: Index, reader: Reader) -> tuple[dict[int, tuple[set[int], bool]], set[int]]:
    """Windows held of each item a text touches, and the items of which it has a long run or all but some words."""
    plain, template, slot, first, cap = reader.read_all(text)
    found: dict[int, dict[int, dict[int, bool]]] = {}
    for form, hashes, same in text_windows(plain, template, slot, first, index.sizes):
        for at in index.known(form, hashes):
            for row, start in index.sizes[form][int(hashes[at])]:
                item, size = index.items[row][3], index.items[row][1]
                # Word by word, be it as it is or by template.
                shape = index.shapes[row][0] if not same else item
                if (shape[start : start + size] == (plain if same else template)[at : at + size]).all() and (size >= MIN_ITEM or _alone(first, at, size)):
                    own = found.setdefault(row, {}).setdefault(at - start, {})
                    own[start] = own.get(start, False) or same
    best: dict[int, tuple[set[int], bool]] = {}
    whole: set[int] = set()
    for row, diagonals in found.items():
        _, size, _, item, slots = index.items[row]
        for offset, good in _consistent(item, slots, plain, size, {o: sorted(starts) for o, starts in diagonals.items()}).items():
            starts = diagonals[offset]
            held, same = best.get(row, (set(), True))
            best[row] = (held | set(good), same and all(starts[s] for s in good))
            exact = sorted(s for s in starts if starts[s])
            if _run(exact, size, np.ones(len(item), bool)) >= MIN_RUN or _run(good, size, ~slots) >= MIN_RUN or len(item) >= SHORT_ITEM.start and _agrees(item, index.shapes[row][0], slots, plain, template, offset):
                whole.add(row)
    if index.seeds:
        hashes = window_hashes(plain, SEED_WINDOW)
        near = {(row, at - start) for at in index.known(_SEEDS, hashes) for row, start in index.seeds[int(hashes[at])]}
        for row, offset in near - {(row, o) for row, diagonals in found.items() for o in diagonals}:
            if _agrees(index.items[row][3], index.shapes[row][0], index.items[row][4], plain, template, offset):
                whole.add(row)
                best.setdefault(row, (set(), False))
    if index.folded and len(plain) >= WINDOW:
        _match_folded(plain, template, slot, first, cap | index.unknown(plain), index, best)
    return best, whole


def matches(text: str | None, index: Index, reader: Reader) -> list[tuple[object, int, int, bool]]:
    """(item, windows found, windows of the item, found as it is) for every item a text touches."""
    best, _ = _looked_up(text, index, reader)
    return [(index.items[row][0], len(held), index.items[row][2], same) for row, (held, same) in best.items() if held]


def found(text: str | None, index: Index, reader: Reader, min_coverage: float = MIN_COVERAGE) -> list[tuple[object, int, int, bool]]:
    """Of the rows of :func:`matches`, those to report.

    An item is held if its windows are covered, if a run of ``MIN_RUN`` plain words
    is there, or if ``MIN_AGREED`` of its words agree on a diagonal. Where windows
    match by template only, those that no template is indexed for don't count.
    """
    best, whole = _looked_up(text, index, reader)
    out = []
    for row, (held, same) in best.items():
        of, by_shape = index.items[row][2], index.shapes[row][1]
        n, some = len(held), int(by_shape.sum())
        covered = n and (n >= min_coverage * of or not same and some and sum(by_shape[s] for s in held) >= min_coverage * some)
        if covered or row in whole:
            out.append((index.items[row][0], n, of, same))
    return out


def _key(text) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, item, word): the salted windows of each item, and the plain words of its folded form."""
    for batch in batches:
        rows: list[tuple[list, list]] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            index = build_index([(item, text.as_py())])
            for hashes, word in ((index.windows(), False), (index.words, True)):
                rows.append((hashes.view(np.int64), [item] * len(hashes), [word] * len(hashes)))
        hashes, items, words = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *hashes])), pa.array(sum(items, []), pa.string()), pa.array(sum(words, []), pa.bool_())], names=["hash", "item", "word"])


def _bits(power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(power)
        for batch in batches:
            bloom.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bloom.bits.tobytes(), 1)], pa.binary())], names=["bits"])

    return run


def bloom_of(hashes: DataFrame) -> Bloom:
    """A Bloom filter of a column of hashes; each partition makes one, and the driver joins them one by one."""
    power = int(np.clip(np.ceil(np.log2(16 * max(1, hashes.count()))), *BLOOM))
    bloom = Bloom(power)
    for row in hashes.coalesce(64).mapInArrow(_bits(power), "bits binary").toLocalIterator():
        bloom.bits |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return bloom


def _candidates(shared, sizes: list[int], seeded: bool):
    """(key, hash): the windows of each text that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, windows, words = Reader(), Bloom(shared.value[0]), Bloom(shared.value[2])
        windows.bits, words.bits = shared.value[1], shared.value[3]
        for batch in batches:
            keys, found = [], []
            # Texts are hashed together as far as a piece goes, and windows that cross from one to the next left out.
            piece = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // PIECE
            cuts = (np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(piece)], strict=True):
                plain, template, slot, first, cap, of = reader.read_many(batch.column(1).slice(lo, hi - lo).to_pylist())
                forms = [(size, ids, size, of) for size in sizes for ids in (plain, template)]
                if seeded:
                    forms.append((SEED_WINDOW, plain, _SEEDS, of))
                names = cap | ~words.holds(plain)
                shape = np.where(names & ~slot, _NAME, template)
                same = (shape[1:] == shape[:-1]) & (slot | names)[1:] & ~first[1:]
                starts = np.concatenate((np.ones(min(1, len(of)), bool), ~same))
                forms.append((WINDOW, shape[starts], _FOLDED, of[starts]))
                for size, ids, form, owner in forms:
                    hashes = salted(window_hashes(ids, size), form)
                    at = windows.hits(hashes)
                    at = at[owner[at] == owner[at + size - 1]]
                    keys.append(owner[at] + lo)
                    found.append(hashes[at].view(np.int64))
            owners = np.concatenate([np.empty(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["key", "hash"])

    return run


def _verified(shared, min_coverage: float):
    """(key, item, windows, item_windows, exact) of each text (key, text, items) and the items that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, words = Reader(), Bloom(shared.value[2])
        words.bits = shared.value[3]
        for batch in batches:
            rows: list[tuple] = []
            for key, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                index = build_index([(x["item"], x["text"]) for x in items.as_py()])
                # As in the scan: all items' plain words, not only these items'.
                index.unknown = lambda plain: ~words.holds(plain)  # type: ignore[method-assign]
                rows += [(key, *x) for x in found(text.as_py(), index, reader, min_coverage)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["key", "item", "windows", "item_windows", "exact"])

    return run


def held_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(key, item, windows, item_windows, exact): texts of ``docs`` and ``benchmark``, by MD5, where one holds the other.

    One scan of the documents for any benchmark: their windows that may be an
    item's are joined with the table of the items' windows, and texts that share
    one are compared with the item, each distinct text once.
    """
    items = written(benchmark.select(_key(F.col(item_text)).alias("item"), F.col(item_text).alias("text")).where(F.col("text") != "").dropDuplicates(["item"]), "items")
    windows = written(items.mapInArrow(_item_windows, "hash long, item string, word boolean"), "item-windows")
    filters = [bloom_of(windows.where(x).select("hash").distinct()) for x in (~F.col("word"), F.col("word"))]
    shared = docs.sparkSession.sparkContext.broadcast(tuple(x for f in filters for x in (f.power, f.bits)))
    counted = items.select(_count(F.col("text")).alias("n")).select(F.least(F.lit(WINDOW), F.col("n")).alias("size"), F.col("n").isin(list(SHORT_ITEM)).alias("short")).distinct().collect()  # at most 2 * WINDOW rows
    sizes, seeded = sorted({r["size"] for r in counted} - {0}), any(r["short"] for r in counted)
    texts = docs.select(_key(F.col(text)).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    hits = texts.mapInArrow(_candidates(shared, sizes, seeded), "key string, hash long").distinct()
    pairs = written(hits.join(few(windows.where(~F.col("word")).select("hash", "item").distinct()), "hash").select("key", "item").distinct(), "pairs")
    counts = pairs.groupBy("key").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).alias("parts"))
    dealt = pairs.join(few(counts), "key").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts"))).join(few(items, "text"), "item")
    dealt = written(dealt.groupBy("key", "part").agg(F.collect_list(F.struct("item", "text")).alias("items")), "dealt")
    whole = written(texts.join(few(counts.select("key")), "key").dropDuplicates(["key"]), "texts")
    rows = dealt.join(whole, "key").select("key", "text", "items")
    return written(rows.mapInArrow(_verified(shared, min_coverage), "key string, item string, windows long, item_windows long, exact boolean"), "held")


def _count(text: Column) -> Column:
    """How many words :class:`Reader` finds."""

    @F.pandas_udf("int")
    def udf(texts: pd.Series) -> pd.Series:
        reader = Reader()
        return pd.Series([len(reader.read(t)[0]) for t in texts], dtype="int32")

    return udf(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Rows (doc_id, item_id, windows, item_windows, coverage, exact): documents that hold an item.

    A document holds an item by the rules of :func:`found`, so ``coverage``, the
    share of all the item's windows, may be less than ``min_coverage``.
    ``exact`` is false if some window matched by its template only. Every text is
    read whole. Null and empty texts match nothing, on either side; items under
    ``MIN_ITEM`` words count where they are a whole sentence or line; items that
    repeat are reported once for each row, as are documents; ids of any type stay
    as they are, null ones too; other columns are ignored; empty tables give no
    rows.
    """
    held = few(held_items(docs, benchmark, text, item_text, min_coverage))
    names = few(benchmark.select(F.col(item_id).alias("item_id"), _key(F.col(item_text)).alias("item")))
    out = docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(text)).alias("key")).join(held, "key").join(names, "item")
    return out.select("doc_id", "item_id", "windows", "item_windows", (F.col("windows") / F.col("item_windows")).alias("coverage"), "exact")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` without the rows that hold an item (as :func:`contaminated` says); all columns as they are.

    Texts are shuffled only where the list of texts to drop is too long to broadcast.
    """
    held = few(held_items(docs, benchmark, text, item_text, min_coverage).select(F.col("key").alias("_held")).distinct())
    rows = docs.select(F.struct("*").alias("row"), _key(F.col(text)).alias("_key"))
    return rows.join(held, F.col("_key") == F.col("_held"), "left_anti").select("row.*")
