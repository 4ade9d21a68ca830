"""Words of many texts at once in any script (numpy, inside tasks): one way of splitting for documents and items."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from strandloom.llm.worker import kept

WORD = re.compile(r"[^\W_]+")
# Fixed value: the soft hyphen, which stands inside words.
SOFT_HYPHEN = "­"
_POWER = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def plain(text: str) -> str:
    """Composed, lower case, without soft hyphens: the form in which words are compared."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).replace(SOFT_HYPHEN, "").lower())


def word_list(text: str) -> list[str]:
    """Words of a text in comparison form: runs of letters and digits of any script."""
    return WORD.findall(plain(text))


def _letters() -> np.ndarray:
    """Whether each code point is a letter or a digit, as the pattern of ``word_list`` has it."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))  # surrogates left out
    out = np.zeros(0x110000, bool)
    for m in WORD.finditer(every):
        out[m.start() : m.end()] = True
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of every word of all texts in order; equal words of ``word_list`` have equal hashes."""
    letters = kept("letters", _letters)
    joined = "\0".join(plain(t).replace("\0", " ") for t in texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = letters[raw]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = stop - start
    inside = np.flatnonzero(letter)
    place = np.minimum(inside - np.repeat(start, lengths), 63)
    value = (raw[inside].astype(np.uint64) + np.uint64(1)) * _POWER[place]
    return np.searchsorted(np.flatnonzero(raw == 0), start), np.add.reduceat(value, np.cumsum(lengths) - lengths)


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each two words in a row."""
    t = hashes[:-1] * _MIX[1] + hashes[1:] * _MIX[2]
    t ^= t >> np.uint64(31)
    t *= _MIX[0]
    return t.view(np.int64)


def trigrams(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each three words in a row."""
    if len(hashes) < 3:
        return np.zeros(0, np.int64)
    t = hashes[:-2] * _MIX[0] + hashes[1:-1] * _MIX[1] + hashes[2:] * _MIX[2]
    t ^= t >> np.uint64(29)
    t *= _MIX[0]
    t ^= t >> np.uint64(32)
    return t.view(np.int64)
