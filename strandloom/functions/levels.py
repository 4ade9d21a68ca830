"""Abundance levels: thresholds, codes and the rank scales over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of level 0, 1 and 2 in occurrences per million, by word length.
THRESHOLDS = {
    2: (48840.0, 68125.0, 76837.0),
    3: (16122.0, 21025.0, 24081.0),
    4: (3165.0, 4747.0, 5986.0),
    5: (820.0, 1173.0, 1638.0),
    6: (178.0, 278.0, 410.0),
    7: (41.0, 66.8, 104.7),
    8: (9.1, 15.7, 26.3),
    9: (2.1, 3.85, 6.74),
    10: (0.5752, 1.0286, 1.9521),
    11: (0.28756, 0.41772, 0.683),
}
# The older, wider bounds.
THRESHOLDS_OLD = {
    2: (73260.0, 102188.0, 115255.0),
    3: (24183.0, 31537.0, 36122.0),
    4: (4747.0, 7121.0, 8979.0),
    5: (1230.0, 1759.0, 2457.0),
    6: (267.0, 417.0, 615.0),
    7: (61.5, 100.2, 157.0),
    8: (13.6, 23.6, 39.4),
    9: (3.1, 5.78, 10.11),
    10: (0.8628, 1.5429, 2.9282),
    11: (0.43134, 0.62658, 1.024),
}
# Scales over level 0..3.
CODES = ("000", "001", "011", "111")
VALUES = (-2, -1, 1, 2)
TEXT = ("--", "+", "++", "+++")
BORDERS = (1.0, 3.5, 8.5, 11.0)
MEDIANS = (0.5, 2.5, 7.5, 9.5)
RANKS = (0.0, 2.5, 7.5, 10.0)
SAMPLE = (0.0, 0.25, 0.75, 1.0)


def check_k(k: int) -> int:
    """``k`` if thresholds exist for it, else ValueError."""
    if k not in THRESHOLDS:
        raise ValueError(f"word length {k} is outside 2..11")
    return k


def level_of(k: int, count: Column, length: Column, thresholds: dict[int, tuple[float, float, float]] = THRESHOLDS) -> Column:
    """Level 0..3 of a count in a sequence of ``length``; null if the length is null or 0."""
    low, mid, high = thresholds[check_k(k)]
    f = F.lit(1e6) * count.cast("double") / F.nullif(length, F.lit(0)).cast("double")
    return F.when(f <= low, 0).when(f <= mid, 1).when(f <= high, 2).when(f > high, 3)


def on_scale(level: Column, scale: tuple) -> Column:
    """The entry of ``scale`` for a level; null for null."""
    out = None
    for i, v in enumerate(scale):
        out = F.when(level == i, F.lit(v)) if out is None else out.when(level == i, F.lit(v))
    return out


def level_of_code(code: Column) -> Column:
    """Level of a thermometer code, also of one whose leading zeros are lost; null for null."""
    return F.length(F.replace(code, F.lit("0"), F.lit("")))


def percentile_of(f: Column, k: Column) -> Column:
    """Clamped log position of a frequency: (ln f + 4.5 ln k - 9) / 3, below .05 as 0, above .95 as 1."""
    p = (F.log(f) + 4.5 * F.log(k) - 9) / 3
    return F.when(f <= 0, F.lit(0.0)).when(p < 0.05, F.lit(0.0)).when(p > 0.95, F.lit(1.0)).otherwise(p)


def border_frequency(p: Column, k: Column) -> Column:
    """Frequency at a percentile: exp(3p + 9) / k^4.5."""
    return F.exp(3 * p + 9) / F.pow(k.cast("double"), F.lit(4.5))


def inserted(levels: Column, place: Column, level: Column) -> Column:
    """``levels`` (an array) with one more level before the 1-based ``place``; a place behind the end appends."""
    at = F.least(place, F.size(levels) + 1)
    return F.concat(F.slice(levels, F.lit(1), at - 1), F.array(level), F.slice(levels, at, F.greatest(F.size(levels) - at + 1, F.lit(0))))


def replaced(levels: Column, place: Column, level: Column) -> Column:
    """``levels`` with the level at the 1-based ``place`` replaced; places outside change nothing."""
    return F.transform(levels, lambda v, i: F.when(i + 1 == place, level).otherwise(v))


def without_places(levels: Column, places: Column) -> Column:
    """``levels`` without those at the 1-based ``places``."""
    return F.filter(levels, lambda v, i: ~F.array_contains(places, i + 1))


def picked(levels: Column, places: Column) -> Column:
    """The levels at the 1-based ``places`` in their order; null for a place outside."""
    return F.transform(places, lambda p: F.get(levels, p - 1))


def merged(levels: Column, more: Column) -> Column:
    """Two genomes' levels one behind the other; a null side counts as none."""
    none = F.array().cast("array<int>")
    return F.concat(F.coalesce(levels, none), F.coalesce(more, none))
