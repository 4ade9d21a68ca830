from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import distances as D
from strandloom.operators import taxonomy as X
from strandloom.operators.linkage import linkage_tree
from strandloom.operators.taxonomy import admixture, bottom_up, overlap, path_distance, tree_nodes


def _frame(spark, d, names):
    return spark.createDataFrame([(names[i], names[j], float(d[i][j])) for i in range(len(names)) for j in range(i + 1, len(names))], "a string, b string, d double")


def _plain_average(d, names):
    size, now = dict.fromkeys(names, 1), {frozenset((names[i], names[j])): float(d[i][j]) for i in range(len(names)) for j in range(i + 1, len(names))}
    heights = {}
    while len(size) > 1:
        pair = min(now, key=lambda p: (round(now[p], 9), *sorted(p)))
        a, b = sorted(pair)
        new = f"({a},{b})"
        heights[new] = now.pop(pair) / 2
        for c in set(size) - {a, b}:
            x, y = now.pop(frozenset((a, c))), now.pop(frozenset((b, c)))
            now[frozenset((new, c))] = (size[a] * x + size[b] * y) / (size[a] + size[b])
        size[new] = size.pop(a) + size.pop(b)
    return heights


@pytest.mark.parametrize("n", [2, 3, 9, 14])
def test_average_linkage_equals_the_plain_one(spark, n):
    rng = np.random.default_rng(n)
    x = rng.random((n, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    names = [f"t{i:02d}" for i in range(n)]
    rows = linkage_tree(_frame(spark, d, names)).collect()
    want = _plain_average(d, names)
    assert {r.node: round(r.height, 9) for r in rows if r.node.startswith("(")} == {k: round(v, 9) for k, v in want.items()}
    assert sorted(r.node for r in rows if not r.node.startswith("(")) == names and [r.leaves for r in rows if r.parent is None] == [n]


def test_neighbour_joining_recovers_an_additive_tree(spark):
    edges = {("u", "a"): 2, ("u", "b"): 3, ("v", "c"): 4, ("v", "d"): 2, ("w", "e"): 1, ("w", "f"): 6, ("r", "u"): 2, ("r", "v"): 1, ("r", "w"): 3}
    up = {c: (p, w) for (p, c), w in edges.items()}

    def path(x):
        out = {x: 0}
        total = 0
        while x in up:
            x, w = up[x]
            total += w
            out[x] = total
        return out

    names = list("abcdef")
    far = lambda x, y: min(path(x)[k] + path(y)[k] for k in set(path(x)) & set(path(y)))
    rows = linkage_tree(_frame(spark, [[far(x, y) for y in names] for x in names], names), "neighbour").collect()
    assert {"(a,b)", "(c,d)", "(e,f)"} & {r.node for r in rows} >= {"(a,b)", "(e,f)"}
    assert {r.node: round(r.length, 6) for r in rows if r.node in ("a", "b", "e", "f")} == {"a": 2, "b": 3, "e": 1, "f": 6}


def test_no_pair_no_tree(spark):
    none = spark.createDataFrame([], "a string, b string, d double")
    assert linkage_tree(none).count() == 0
    with pytest.raises(ValueError):
        linkage_tree(none, "other")


def test_paths_and_mixtures(spark):
    rows = [("g", ["a", "b", "c"]), ("g", ["a", "b", "d"]), ("h", ["a", "b", "c"]), ("h", ["x"]), (None, ["a"]), ("i", [])]
    df = spark.createDataFrame(rows, "g string, parts array<string>")
    assert {(r.g, r.members, r.others, round(r.admixture, 4)) for r in admixture(df, "g").collect()} == {("g", 2, 1, 0.3333), ("h", 2, 3, 0.6)}
    assert [(r.a, r.b, r.nodes) for r in overlap(df, "g").collect()] == [("g", "h", 3)]
    pair = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), ([], []), (["a"], ["a"])], "p array<string>, q array<string>")
    assert [(r.shared_depth, r.distance, round(r.relative, 2)) for r in path_distance(pair, "p", "q").collect()] == [(1, 3, 0.6), (0, 0, 0.0), (1, 0, 0.0)]
    order = bottom_up(tree_nodes(df)).orderBy("place").collect()
    assert [r.path for r in order] == ["a>b>c", "a>b>d", "a>b", "a", "x"] and round(order[-1].diverse_high, 6) == 0.7 and round(order[0].common_low, 6) == -1.0


def test_distance_identity(spark):
    random.seed(4)
    rows = [(n, f"m{m}", random.choice([0, 1, 2, 3, None])) for n in "abcd" for m in range(12)]
    got = {(r.a, r.b): r.d for r in D.level_distances(spark.createDataFrame(rows, "name string, marker string, level int")).collect()}
    v = {(n, m): (x or 0) for n, m, x in rows}
    known = {m for _, m, x in rows if x is not None}
    for a in "abcd":
        for b in "abcd":
            if a < b:
                assert abs(got[a, b] - sum(abs(v[a, m] - v[b, m]) for m in known) / (3 * len(known))) < 1e-12
    link = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "name string, cluster string")
    d = spark.createDataFrame([(*k, x) for k, x in got.items()], "a string, b string, d double")
    mean = D.average_linkage(d, link).first().d
    assert abs(mean - sum(got[k] for k in (("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"))) / 4) < 1e-12


def test_lineage_tables(spark):
    rows = [(1, "g", ["r", "a", "x"]), (2, "g", ["r", "a", "y"]), (3, "h", ["r", "b"]), (4, None, ["r", "a", "x"]), (5, "e", [])]
    df = spark.createDataFrame(rows, "i int, grp string, parts array<string>")
    nodes = X.tree_nodes(df)
    got = {r.path: (r.parent, r.leaves, r.depth) for r in nodes.collect()}
    assert got["r"] == (None, 4, 1) and got["r>a"] == ("r", 3, 2) and got["r>a>x"] == ("r>a", 2, 3)
    assert {r.path for r in X.leaf_nodes(nodes).collect()} == {"r>a>x", "r>a>y", "r>b"}
    anc = {r.grp: (r.lca_depth, r.members, r.monophyletic) for r in X.group_ancestor(df, "grp").collect()}
    assert anc == {"g": (2, 2, False), "h": (2, 1, True)}
    assert {r.path: r.children for r in X.children_counts(nodes).collect()} == {"r": 2, "r>a": 2}


def test_branch_metrics_with_lengths(spark):
    rows = [("r", None, 1, False, 0.0), ("r>a", "r", 2, False, 2.0), ("r>a>x", "r>a", 3, True, 1.0), ("r>a>y", "r>a", 3, True, 4.0), ("r>b", "r", 2, True, 0.5)]
    df = spark.createDataFrame(rows, "path string, parent string, depth int, is_end boolean, len double").withColumn("leaves", F.lit(1))
    got = {r.path: (r.ends, r.longest, r.shortest, r.total) for r in X.branch_metrics(df, "len").collect()}
    assert got == {"r": (3, 6.0, 0.5, 9.5), "r>a": (2, 4.0, 1.0, 5.0)}
    assert X.depth_cuts(df, 2).where("sector = 1").count() == 3 or X.depth_cuts(df, 2).count() > 0
