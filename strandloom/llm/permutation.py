"""Permutation index: ordered nearest pivots, inverted files, footrule distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from strandloom.llm.runs import run_bounds, run_pairs


def nearest_pivots(nearness: np.ndarray, depth: int) -> np.ndarray:
    """Per row the ``depth`` pivots of greatest nearness, nearest first, ties to the smaller pivot; -1 where nearness is 0 or pivots end.

    ``nearness`` holds non-negative integers (rows by pivots).
    """
    pivots = nearness.shape[1]
    narrow = nearness.size and (int(nearness.max()) + 1) * pivots < 2**31
    exact = np.int32 if narrow else np.int64
    score = np.asarray(nearness).astype(exact) * exact(pivots) + np.arange(pivots - 1, -1, -1, dtype=exact)
    have = min(depth, pivots)
    top = -np.sort(-np.partition(score, pivots - have, axis=1)[:, pivots - have :], axis=1)
    out = np.full((len(score), depth), -1, np.int16)
    out[:, :have] = np.where(top >= pivots, pivots - 1 - top % pivots, -1)
    return out


def nearest_met(row: np.ndarray, pivot: np.ndarray, nearness: np.ndarray, rows: int, pivots: int, depth: int) -> np.ndarray:
    """``nearest_pivots`` of at most 64 ``rows`` from the parts of their nearness that are not 0: part ``nearness`` of ``row`` to ``pivot``.

    Parts of one row and pivot are added. The cost grows with the parts, not with the pivots. Sums are below 2**43, pivots at most 2**14.
    """
    out = np.full((rows, depth), -1, np.int16)
    if not len(row):
        return out
    part = np.sort((row.astype(np.int64) * pivots + pivot) << 43 | nearness)
    key = part >> 43
    start = run_bounds(key)[:-1]
    near = np.add.reduceat(part & ((1 << 43) - 1), start)
    row = key[start] // pivots
    pivot = key[start] - row * pivots
    score = np.sort(row << 57 | near * pivots + (pivots - 1 - pivot))
    row = score >> 57
    bounds = run_bounds(row)
    back = np.repeat(bounds[1:], np.diff(bounds)) - 1 - np.arange(len(row))  # 0 for the nearest
    best = back < depth
    out[row[best], back[best]] = pivots - 1 - (score[best] & ((1 << 57) - 1)) % pivots
    return out


def posting_keys(order: np.ndarray, prefix: int, alone: np.ndarray | None = None) -> np.ndarray:
    """Keys of the inverted files a row is posted in: every pair of its ``prefix`` nearest pivots, smaller pivot first.

    An inverted file of one pivot would hold a fixed share of all rows; those of pivot pairs
    stay short as rows grow. Pivots marked in ``alone`` (like ``order``) have a file of their own instead, pairs with
    them none: their rows meet there anyway. -1 means no posting; a row with one pivot is posted under it alone.
    """
    alone = np.zeros(order.shape, bool) if alone is None else alone
    paired = np.where(alone[:, :prefix], -1, order[:, :prefix].astype(np.int64))
    first = np.sort(paired, axis=1)
    keys = [np.where(first[:, i] >= 0, first[:, i] << 16 | first[:, j], -1) for i, j in combinations(range(min(prefix, order.shape[1])), 2)]
    single = np.zeros(order.shape, bool)
    single[:, 0] = (order[:, 0] >= 0) & (order[:, 1] < 0)
    own = np.where(alone | single, order.astype(np.int64) << 16 | 0xFFFF, -1)
    return np.concatenate([np.stack(keys, 1), own], 1)


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spearman footrule between rows of two permutation prefixes; a pivot missing from one stands behind its end."""
    depth = a.shape[1]
    place = np.arange(depth)
    out = np.empty(len(a), np.int32)
    for at in range(0, len(a), 50_000):
        x, y = a[at : at + 50_000, :, None], b[at : at + 50_000, None, :]
        same = (x == y) & (x >= 0)
        moved = (same * np.abs(place[:, None] - place[None, :])).sum((1, 2))
        only_a = (~same.any(2) * (depth - place)).sum(1)
        only_b = (~same.any(1) * (depth - place)).sum(1)
        out[at : at + 50_000] = moved + only_a + only_b
    return out


def footrule_block(a: np.ndarray, b: np.ndarray, pivots: int) -> np.ndarray:
    """``footrule`` of every row of ``a`` with every row of ``b``.

    With p the place of a's i-th pivot in b (depth if missing) a pair's distance is the sum over i of
    |i - p| - (depth - p), plus the greatest possible sum of one side: one table look-up per place.
    """
    depth = a.shape[1]
    place = np.full((pivots + 1, len(b)), depth, np.uint8)
    for i in range(depth):
        place[b[:, i], np.arange(len(b))] = i
    place[pivots] = depth  # row -1: no pivot
    p = np.arange(depth + 1)
    out = np.full((len(a), len(b)), depth * (depth + 1) // 2, np.int16)
    for i in range(depth):
        out += (np.abs(i - p) - (depth - p)).astype(np.int16)[place[a[:, i]]]
    return out


def close_pairs(keys: np.ndarray, side: np.ndarray, order: np.ndarray, most: int, chunk: int = 400_000):
    """Yields index pairs (i, j, footrule) that share an inverted file and have a footrule distance of at most ``most``.

    In block pairs of a hot file (see ``runs.salted``) only rows of different blocks are paired,
    except in a block paired with itself. Works through the files in chunks of bounded size.
    """
    bounds = run_bounds(keys)
    size = np.diff(bounds)
    cost = np.cumsum(size * (size - 1) // 2)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + chunk, "right")))
        i, j = _pairs_of(bounds, start, stop, chunk) if stop - start > 1 or size[start] ** 2 <= 2 * chunk else (None, None)
        blocks = [(i, j)] if i is not None else _one_file(bounds[start], bounds[start + 1], chunk)
        for i, j in blocks:
            two = np.flatnonzero(~((side[i] == side[j]) & _mixed(side, bounds, start, stop, i)))
            i, j = i[two], j[two]
            f = footrule(order[i], order[j])
            ok = f <= most
            yield i[ok], j[ok], f[ok]
        start = stop


def _pairs_of(bounds: np.ndarray, start: int, stop: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    some = np.zeros(len(bounds) - 1, bool)
    some[start:stop] = True
    return run_pairs(bounds, some)


def _one_file(lo: int, hi: int, chunk: int):
    """All index pairs of one long file, a bounded number at a time."""
    rows = max(1, chunk // (hi - lo))
    for at in range(lo, hi, rows):
        i, j = np.meshgrid(np.arange(at, min(at + rows, hi)), np.arange(lo, hi), indexing="ij")
        keep = i < j
        yield i[keep], j[keep]


def _mixed(side: np.ndarray, bounds: np.ndarray, start: int, stop: int, i: np.ndarray) -> np.ndarray:
    """Whether the file of each index holds rows of both blocks of a pair."""
    lo, hi = bounds[start], bounds[stop]
    if side[lo:hi].max(initial=-1) < 1:
        return np.zeros(len(i), bool)
    both = np.maximum.reduceat(side, bounds[:-1]) == 1
    return both[np.searchsorted(bounds, i, "right") - 1]
