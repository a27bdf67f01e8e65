"""Words and shingle sets of whole texts, as arrays."""

from __future__ import annotations

import numpy as np

from strider.llm.common import mix64

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
#: ASCII upper case folds to lower case; space and 0x09-0x0D separate words.
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = _BYTE[_FOLD]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and for each text the index of its first word (n + 1 entries)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    last = inside.copy()
    last[:-1] &= space[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE))), dtype=np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[raw] * power, dtype=np.uint64)))
        inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _INVERSE))), dtype=np.uint64)
        out = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return out, np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct `size`-word shingles of each text as rising 64-bit hashes, and where each text's begin (n + 1).

    A text with fewer words has its whole sequence as its only shingle; one without words has none."""
    w, at = words(raw, offsets)
    counts = np.diff(at)
    n_texts = len(counts)
    with np.errstate(over="ignore"):
        if len(w) >= size:
            h = np.zeros(len(w) - size + 1, np.uint64)
            for j in range(size):
                h = mix64(h + w[j : len(w) - size + 1 + j] * np.uint64(2 * j + 3))
        else:
            h = np.empty(0, np.uint64)
        owner = np.repeat(np.arange(n_texts), counts)[: len(h)]
        inside = np.arange(len(h)) + size <= at[owner + 1] if len(h) else np.empty(0, bool)
        h, owner = h[inside], owner[inside]
        short = np.flatnonzero((counts > 0) & (counts < size))
        extra = np.zeros(len(short), np.uint64)
        for k in range(1, size):
            has = counts[short] >= k
            extra[has] = mix64(extra[has] + w[at[short[has]] + k - 1] * np.uint64(2 * k + 1))
        extra = mix64(extra ^ counts[short].astype(np.uint64))
    h, owner = np.concatenate((h, extra)), np.concatenate((owner, short))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n_texts + 1))
