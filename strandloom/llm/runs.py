"""Streaming over rows sorted by a key inside a task, a bounded number of whole keys at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut_lineage, small


def whole_keys(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.Table]:
    """Tables that hold whole runs of ``key``: the last, perhaps unfinished run waits for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        keys = now.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Start positions of the runs of sorted keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def run_pairs(bounds: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j inside each run for which ``ok`` (per run) holds."""
    start, size = bounds[:-1][ok], np.diff(bounds)[ok]
    left = np.repeat(start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    after = np.repeat(start + size, size) - left - 1  # partners behind each row
    i = np.repeat(left, after)
    j = i + 1 + (np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after))
    return i, j


def salted(postings: DataFrame, key: str, id_col: str, most: int) -> DataFrame:
    """``postings`` with keys that no more than about 2 * ``most`` rows share.

    A key of n > ``most`` rows is cut into s = ceil(n / most) blocks and every row goes to the
    s block pairs of its own block, so that each pair of rows still meets under some key: an
    exact way for hot keys, whose work is spread over s * (s + 1) / 2 tasks' worth of groups.
    Adds ``side``: -1 under a whole key, else 0 or 1 for the first or second block of a pair
    (a block paired with itself has side 0 only).
    """
    hot = postings.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = hot.select(key, F.ceil(F.col("_n") / F.lit(most)).cast("int").alias("_s"))
    hot = cut_lineage(hot)  # a row per hot key: the count behind `small` must not build the postings again
    marked = postings.join(small(hot, 100_000), key, "left")
    own = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.col("_s").cast("bigint")).cast("int")
    other: Column = F.explode(F.when(F.col("_s").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("_s") - 1)))
    marked = marked.withColumn("_own", own).withColumn("_other", other)
    block = F.xxhash64(F.col(key), F.least("_own", "_other"), F.greatest("_own", "_other"))
    side = F.when(F.col("_s").isNull(), F.lit(-1)).when(F.col("_own") <= F.col("_other"), F.lit(0)).otherwise(F.lit(1))
    return marked.withColumn(key, F.when(F.col("_s").isNull(), F.col(key)).otherwise(block)).withColumn("side", side.cast("int")).drop("_own", "_other", "_s")


def by_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Hash-partitioned and sorted by ``key``, ready for ``whole_keys``."""
    return df.repartition(key).sortWithinPartitions(key)
