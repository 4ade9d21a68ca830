"""Words of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC3, 0xC5), *range(0x80, 0xC0)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWER = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)


@dataclass
class Words:
    """Byte row of all texts, end of each text in it, and per word its text, bytes [start, stop) and hash."""

    raw: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray


def hash_word(word: str) -> np.uint64:
    """Hash of one word, as in ``split_words``."""
    b = LOWER[np.frombuffer(word.encode(), np.uint8)].astype(np.uint64)
    return (b * _POWER[np.minimum(np.arange(len(b)), 63)]).sum(dtype=np.uint64)


def split_words(texts: list[str], digits: bool = True) -> Words:
    """Words are runs of letters (ASCII and UTF-8 Latin) and, with ``digits``, of digits; hashes ignore ASCII case."""
    raw = np.frombuffer(("\0".join(t.replace("\0", " ") for t in texts) + "\0").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(raw == 0)
    letter = LETTER[raw]
    if not digits:
        letter &= ~((raw >= 48) & (raw <= 57))
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(raw, ends, none, none, none, np.zeros(0, np.uint64))
    lengths = stop - start
    inside = np.flatnonzero(letter)
    place = np.minimum(inside - np.repeat(start, lengths), 63)
    value = LOWER[raw[inside]].astype(np.uint64) * _POWER[place]
    return Words(raw, ends, np.searchsorted(ends, start), start, stop, np.add.reduceat(value, np.cumsum(lengths) - lengths))
