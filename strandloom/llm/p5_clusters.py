"""Problem 5: clusters of mutually similar level vectors by subspace grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.levels import ENTRIES, as_binary, as_rows, bit_words, distances, packed_vectors, thermometer, unpacked
from strandloom.llm.runs import by_key, run_bounds, run_pairs, salted, whole_keys
from strandloom.operators.graph import connected_components
from strandloom.session import cut_lineage, table

RADIUS = 24  # 0.06 of 3 * 136 levels
BLOCK = 2048  # members of a cell from which it is compared in block pairs


def _least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reached from each of ``n`` rows over links i-j."""
    low = np.arange(n)
    while len(i):
        was = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == was).all():
            break
    return low


def _cell_star(levels: np.ndarray, side: np.ndarray, copies: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius inside one large cell, and the rows around each member, its own included.

    Each member is linked to its first near member; two first members are linked if near members have them. That spans
    the same components as all pairs, of which no list is made. In a block pair, rows of the own block are counted elsewhere.
    """
    t = thermometer(levels)
    n = len(t)
    near = np.zeros((n, n), bool)
    for lo in range(0, n, 1024):
        near[lo : lo + 1024] = distances(t[lo : lo + 1024], t) <= radius
    first = near.argmax(1)
    both = [np.stack([first, np.arange(n)])]
    for lo in range(0, n, 1024):
        x, y = np.nonzero(near[lo : lo + 1024] & (first[lo : lo + 1024, None] != first[None, :]))
        if len(x):
            both.append(np.stack(np.divmod(np.unique(first[lo + x] * n + first[y]), n)))
    if side.max() == 1 and side.min() == 0:
        near &= side[:, None] != side[None, :]
        near[np.arange(n), np.arange(n)] = True
    return np.concatenate(both, 1), near.astype(np.float32) @ copies.astype(np.float32)


def grid_groups(points: int) -> int:
    """Groups for a number of points: more groups mean fewer grids with wider cells. Any number gives the same clusters; this one keeps cells short as points grow."""
    return 14 if points <= 100_000 else 11 if points <= 1_000_000 else 8 if points <= 10_000_000 else 5


def grid_cells(vectors: DataFrame, radius: int, groups: int) -> DataFrame:
    """``(key, id, copies, vec)``: the cells of every vector ``(id, copies, vec)``, one in each grid.

    The features are the levels themselves, already four steps of a quantised frequency. The entries are cut into
    ``radius`` + ``groups`` + 1 parts, dealt to the groups; a grid is spanned by two parts of one group, and a cell is the levels of both. Two vectors
    within the radius differ in at most ``radius`` parts, so more than one part of some group is left the same, and they share a cell.
    """
    parts = radius + groups + 1
    pairs = [(i, j) for i in range(parts) for j in range(i + groups, parts, groups)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.linspace(0, ENTRIES, parts + 1).astype(int)
        wide_as = 4 ** int(np.diff(cuts).max())
        left, right = (np.array(x) for x in zip(*pairs, strict=True))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                data = as_rows(part.column(2), ENTRIES // 4)
                levels, n = unpacked(data).astype(np.int64), part.num_rows
                code = np.stack([levels[:, lo:hi] @ (4 ** np.arange(hi - lo)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], 1)
                keys = np.arange(len(pairs)) + len(pairs) * (code[:, left] + wide_as * code[:, right])
                again = pa.array(np.repeat(np.arange(n), len(pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(part.column(c).take(again) for c in (0, 1, 2))], ["key", "id", "copies", "vec"])

    return vectors.select("id", "copies", "vec").mapInArrow(cells, "key bigint, id bigint, copies bigint, vec binary")


def cell_links(cells: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(a, b, dense)``: each member of a cell with the smallest member that it reaches there in steps of at most ``radius``.

    Distances inside a cell are all compared, but only this spanning star leaves the task:
    one row per member, never pairs. Cells of more than ``block`` members are compared in
    block pairs. ``dense`` is the number of rows within the radius in the cell (of a cut one, in the block pair), the member's copies included.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            keys, ids, side, copies = (rows.column(c).to_numpy() for c in ("key", "id", "side", "copies"))
            bounds = run_bounds(keys)
            if len(bounds) > len(ids):  # no cell of two
                continue
            alone = np.repeat(np.diff(bounds) == 1, np.diff(bounds))
            if alone.any():
                kept = np.flatnonzero(~alone)
                rows, keys, ids, side, copies = rows.take(pa.array(kept)), keys[kept], ids[kept], side[kept], copies[kept]
                bounds = run_bounds(keys)
            levels = unpacked(as_rows(rows.column("vec"), ENTRIES // 4))
            size = np.diff(bounds)
            near = copies.astype(np.float64)
            mixed = np.repeat((np.maximum.reduceat(side, bounds[:-1]) == 1) & (np.minimum.reduceat(side, bounds[:-1]) == 0), size)
            i, j = run_pairs(bounds, size <= 24)
            words = bit_words(levels)
            ok = np.zeros(len(i), bool)
            for at in range(0, len(i), 200_000):
                s = slice(at, at + 200_000)
                ok[s] = np.bitwise_count(words[i[s]] ^ words[j[s]]).sum(1, dtype=np.int64) <= radius
            i, j = i[ok], j[ok]
            links = [(i, j)]
            for r in np.flatnonzero(size > 24):
                at = slice(bounds[r], bounds[r + 1])
                first, within = _cell_star(levels[at], side[at], copies[at], radius)
                near[at] = within
                links.append((bounds[r] + first[0], bounds[r] + first[1]))
            own = ~(mixed[i] & (side[i] == side[j]))  # counted in the block's own pair
            near += np.bincount(i[own], weights=copies[j[own]], minlength=len(ids)) + np.bincount(j[own], weights=copies[i[own]], minlength=len(ids))
            li, lj = (np.concatenate(z) for z in zip(*links, strict=True))
            low = _least_reached(len(ids), li, lj)
            # positions are not in id order: take the smallest id of each reached set
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, low, ids)
            b = least[low]
            out = (near > copies) | (b != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(b[out]), pa.array(near[out].astype(np.int64))], ["a", "b", "dense"])

    posted = salted(cells, "key", "id", block)
    return by_key(posted).mapInArrow(link, "a bigint, b bigint, dense bigint")


def grid_density_clusters(vectors: DataFrame, radius: int = RADIUS, groups: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(id, cluster_id, density)`` for every vector in a cluster of at least two.

    Vectors within ``radius`` of one another, directly or over others, share a cluster;
    cluster_id is the smallest id in it. Steps: equal vectors are one grid point with a count;
    points fall into the cells of the grids (``grid_cells``), in one of which any two points within the radius meet; cells of two points or more link
    the points within the radius; cells with a common point are adjacent, and minimum labels
    run over these adjacencies to convergence. ``density`` is the number of rows around a vector, its own copies included, in the
    densest of its cells. ``vectors(id, vec)`` as of ``packed_vectors``; equal vectors and a
    third of all rows in one cell are fine; no rows give no rows.
    """
    vectors = cut_lineage(vectors)
    points = cut_lineage(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    links = cut_lineage(cell_links(grid_cells(points, radius, groups or grid_groups(points.count())), radius, block).groupBy("a", "b").agg(F.max("dense").alias("dense")))
    labels = connected_components(links.select("a", "b")).select(F.col("node").alias("id"), "component")
    density = links.groupBy(F.col("a").alias("id")).agg(F.max("dense").alias("dense"))
    known = points.join(labels, "id", "left").join(density, "id", "left")
    known = known.where("component is not null or copies > 1")
    known = known.select("vec", F.coalesce("component", "id").alias("cluster_id"), F.coalesce("dense", "copies").alias("density"))
    return vectors.join(known, "vec").select("id", "cluster_id", "density")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return packed_vectors(table(spark, d, "wdb_values"), "value_id", "level_values")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each vector in a cluster of at least two and the cluster's smallest value_id."""
    return grid_density_clusters(_vectors(spark, d)).select(F.col("id").alias("value_id"), "cluster_id")


def p5_clusters(spark: SparkSession, d: str, typical: int = 3) -> DataFrame:
    """Each cluster with its size and the value_id and accession of its ``typical`` densest members."""
    found = cut_lineage(grid_density_clusters(_vectors(spark, d)))
    size = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    best = W.partitionBy("cluster_id").orderBy(F.desc("density"), "id")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= typical)
    named = table(spark, d, "wdb_values").select(F.col("value_id").alias("id"), "accession")
    return top.join(named, "id").join(size, "cluster_id").select("cluster_id", "size", "place", F.col("id").alias("value_id"), "accession", "density")
