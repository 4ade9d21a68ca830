from __future__ import annotations

import numpy as np
import pytest
from test_neighbours import _frame, _level_rows

from strandloom.llm import p5_clusters as C
from strandloom.llm.levels import packed_vectors


def _brute(rows, radius):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids]).astype(int)
    near = np.abs(x[:, None] - x[None]).sum(2) <= radius
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=len(ids))
    return {ids[i]: ids[label[i]] for i in range(len(ids)) if size[label[i]] > 1}


@pytest.mark.parametrize("block", [2048, 10])
def test_clusters_against_all_pairs(spark, block):
    rows = _level_rows(240, 30, 9, seed=5)
    rows[9001] = rows[9003] = np.zeros(136, int)  # a cluster of copies only
    extra = [(7001, None), (7003, []), (None, ["001"])]
    got = {r.id: r.cluster_id for r in C.grid_density_clusters(packed_vectors(_frame(spark, rows, extra), "value_id", "level_values"), block=block).collect()}
    assert got == _brute(rows, 24)


def test_chains_join_what_is_far_apart(spark):
    base = np.zeros(136, int)
    rows = {i: np.where(np.arange(136) < 16 * i, 1, base) for i in range(6)}  # each 16 from the next
    got = {r.id: r.cluster_id for r in C.grid_density_clusters(packed_vectors(_frame(spark, rows), "value_id", "level_values")).collect()}
    assert got == dict.fromkeys(range(6), 0)


def test_hot_cell_and_nothing(spark):
    rng = np.random.default_rng(1)
    rows = {i: np.where(rng.random(136) < 0.03, 1, 0) for i in range(400)}
    got = {r.id: r.cluster_id for r in C.grid_density_clusters(packed_vectors(_frame(spark, rows), "value_id", "level_values"), block=50).collect()}
    assert got == _brute(rows, 24)
    assert C.grid_density_clusters(packed_vectors(_frame(spark, {}), "value_id", "level_values")).count() == 0


def test_density_prefers_the_middle(spark):
    base = np.ones(136, int)
    rows = {0: base, **{i: np.where(np.arange(136) % 12 == i, 2, base) for i in range(1, 8)}, 50: base, 51: base}
    got = {r.id: r.density for r in C.grid_density_clusters(packed_vectors(_frame(spark, rows), "value_id", "level_values")).collect()}
    assert max(got, key=lambda i: (got[i], -i)) == 0


@pytest.mark.parametrize(("block", "groups"), [(2048, None), (4, None), (2048, 5), (2048, 8), (2048, 11)])
def test_pairs_whose_differences_touch_every_subspace(spark, block, groups):
    rng = np.random.default_rng(3)
    rows = {}
    for n in range(20):
        base = rng.integers(0, 3, 136)
        spread = np.linspace(0, 135, 24 + n % 2).astype(int)  # 24 steps are within the radius, 25 are not
        rows[10 * n], rows[10 * n + 1] = base, base + np.isin(np.arange(136), spread)
    got = {r.id: r.cluster_id for r in C.grid_density_clusters(packed_vectors(_frame(spark, rows), "value_id", "level_values"), groups=groups, block=block).collect()}
    assert got == _brute(rows, 24) and len(got) == 20


@pytest.mark.parametrize("block", [2048, 30])
def test_density_counts_every_row_once(spark, block):
    rng = np.random.default_rng(2)
    base = np.ones(136, int)
    rows = {i: base + (np.arange(136) == i % 7) for i in range(70)}  # seven vectors of ten rows, two steps apart
    rows |= {100 + i: np.where(rng.random(136) < 0.5, 0, 3) for i in range(5)}
    got = {r.id: r.density for r in C.grid_density_clusters(packed_vectors(_frame(spark, rows), "value_id", "level_values"), block=block).collect()}
    assert got == dict.fromkeys(range(70), 70)
