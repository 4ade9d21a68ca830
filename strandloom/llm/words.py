"""Vectors of word counts of sequences (numpy, inside tasks): 8-letter words, strands counted together."""

from __future__ import annotations

import numpy as np

K = 8
_BASE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _BASE[ord(_c.lower())] = _i
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _canonical() -> np.ndarray:
    """Code of every word -> number of the smaller of it and its reverse complement, numbered from 0."""
    code = np.arange(4**K)
    reverse = np.zeros_like(code)
    for i in range(K):
        reverse = reverse * 4 + (3 - (code >> 2 * i & 3))
    _, number = np.unique(np.minimum(code, reverse), return_inverse=True)
    return number.astype(np.uint16)


WORD = _canonical()
WORDS = int(WORD.max()) + 1


def bases(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bases 0..3 of all texts in a row, the number of bases per text, and where (in the row) a new unbroken stretch begins.

    Case and white space are ignored; any other character ends a stretch. Text starts are included.
    """
    raw = np.frombuffer("|".join(texts).encode("utf-8", "replace"), np.uint8)
    if raw.size and _BLANK[raw].any():
        raw = raw[~_BLANK[raw]]
    code = _BASE[raw]
    bad = np.flatnonzero(code == 4)
    ends = np.flatnonzero(raw[bad] == 124) if len(texts) > 1 else np.zeros(0, np.int64)
    # a '|' inside a text would be taken for a text's end
    if len(ends) != len(texts) - 1:
        return bases([t.replace("|", "?") for t in texts])
    good = np.delete(code, bad)
    before = bad - np.arange(len(bad))  # bases before each bad character
    edges = np.concatenate([[0], before[ends], [len(good)]])
    return good, np.diff(edges), np.unique(np.concatenate([edges[:-1], before]))


def words_of(good: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word at every position of a row of bases, and whether it lies inside one stretch."""
    n = len(good) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint16), np.zeros(0, bool)
    two = good[:-1] << 2 | good[1:]
    four = two[:-2] << 4 | two[2:]
    eight = four[:-4].astype(np.uint16) << 8 | four[4:]
    ok = np.ones(n, bool)
    for back in range(1, K):
        at = breaks - back
        ok[at[(at >= 0) & (at < n)]] = False
    return WORD[eight], ok


def two_bits(good: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts at four bases a byte, each from a byte of its own; and the byte offsets."""
    size = -(-lengths // 4)
    offsets = np.concatenate([[0], np.cumsum(size)])
    shift = np.repeat(offsets[:-1] * 4 - (np.cumsum(lengths) - lengths), lengths)
    out = np.zeros(int(offsets[-1]) * 4, np.uint8)
    out[np.arange(len(good)) + shift] = good
    return out[0::4] | out[1::4] << 2 | out[2::4] << 4 | out[3::4] << 6, offsets.astype(np.int32)


def from_two_bits(data: bytes, length: int) -> np.ndarray:
    """Bases of one text of ``two_bits``."""
    b = np.frombuffer(data, np.uint8)
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], 1).ravel()[:length]
