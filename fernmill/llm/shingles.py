"""Word shingles as hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingles(text: str | None, shingle: int) -> list[int]:
    """XXH64 of each run of ``shingle`` words.

    A-Z is lower-cased; words are runs of anything but ASCII white space. Fewer
    words than a shingle make one shingle of them all; no words (or null) make none.
    """
    words = (text or "").encode().lower().split()
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def shingle_set(hashes: list[int]) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(np.array(hashes, np.uint64))
