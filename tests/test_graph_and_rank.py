from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandloom.operators.graph import connected_components
from strandloom.operators.ranking import global_rank


def brute(edges):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_against_union_find(spark):
    random.seed(3)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(1000, 1060)]  # a long path
    edges += [(5000, i) for i in range(5001, 5300)]  # a hub
    edges += [(7, None), (None, None), (9000, 9000)] + edges[:10]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_global_rank_with_ties_and_hot_key(spark):
    rows = [("hot", i) for i in range(400)] + [("k%d" % (i % 7), 1000 + i) for i in range(200)]
    random.shuffle(rows)
    got = global_rank(spark.createDataFrame(rows, "k string, i int"), [F.col("k"), F.col("i")], "r").collect()
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.r)] == sorted(rows)
    assert sorted(r.r for r in got) == list(range(1, 601))
    assert global_rank(spark.createDataFrame([], "k string, i int"), [F.col("k")], "r").count() == 0
