from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.llm import names, p2_sample, p3_split, p4_splits


def test_sample_follows_targets_and_keeps_floors(spark):
    rows = [(f"u{i}", "big") for i in range(600)] + [(f"v{i}", "mid") for i in range(300)] + [(f"w{i}", "small") for i in range(5)] + [("u1", "mid"), ("u1", "big"), (None, "big"), ("z", None), ("q", "unlisted")]
    members = spark.createDataFrame(rows, "unit string, category string").withColumn("available", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.0, 1)], "category string, target_share double, min_rows int").withColumn("wanted", F.lit("clash"))
    sample, report = p2_sample.sample_to_targets(members, targets, 200)
    got = {r.category: (r.available, r.drawn, r.short) for r in report.collect()}
    assert got["small"] == (5, 5, True) and got["none"] == (0, 0, True)
    assert sum(x[1] for x in got.values()) == 200
    assert abs(got["big"][1] / got["mid"][1] - 5 / 3) < 0.03 and not got["big"][2]  # the seats of small went to both in proportion
    units = [r.unit for r in sample.collect()]
    assert len(units) == len(set(units)) == 200
    again = [r.unit for r in p2_sample.sample_to_targets(members, targets, 200)[0].collect()]
    assert sorted(units) == sorted(again)


def test_floor_comes_before_shares(spark):
    members = spark.createDataFrame([(i, "a") for i in range(100)] + [(200 + i, "b") for i in range(100)], "unit int, category string")
    targets = spark.createDataFrame([("a", 0.99, 1), ("b", 0.01, 5)], "category string, target_share double, min_rows int")
    got = {r.category: r.drawn for r in p2_sample.sample_to_targets(members, targets, 20)[1].collect()}
    assert got == {"a": 15, "b": 5}


def test_empty_sample(spark):
    members = spark.createDataFrame([], "unit string, category string")
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", None, None)], "category string, target_share double, min_rows int")
    sample, report = p2_sample.sample_to_targets(members, targets, 10)
    assert sample.count() == 0 and {r.category: r.short for r in report.collect()} == {"a": True, "b": False}
    none = spark.createDataFrame([], "category string, target_share double, min_rows int")
    assert p2_sample.target_report(members, none, 5).count() == 0


def test_names(spark):
    df = spark.createDataFrame([(" zwb_00286866.1", "p__Abc", "Kaph sp."), ("ZWB00286866", "ABC ", "kaph"), ("unknown", None, None), ("-", "", "")], "a string, b string, c string")
    r = df.select(names.accession_key(F.col("a")).alias("a"), names.rank_name_key(F.col("b")).alias("b"), names.genus_key(F.col("c")).alias("c")).collect()
    assert r[0].a == r[1].a and r[2].a is None and r[3].a is None and r[0].b == r[1].b == "abc" and r[0].c == r[1].c == "kaph"
    lin = ["x|Gen_spec_str._BW_1|A1", "Gen  SPEC strain bw 1", "x|unclassified bacterium|A2", "NA", None, "a|b"]
    o = [x[0] for x in spark.createDataFrame([(x,) for x in lin], "l string").select(names.organism_key(F.col("l"))).collect()]
    assert o == ["gen spec bw 1", "gen spec bw 1", None, None, None, "a"]


def _greedy(n, ends, limit, overlap):
    pieces, at = [], 0
    nodes = sorted({e for e in ends if 0 < e < n} | {n})
    while at < n:
        start = max(1, at - overlap + 1) if at else 1
        reach = (at + limit - overlap) if at else limit
        inside = [e for e in nodes if at < e <= reach]
        stop = max(inside) if inside else reach
        pieces.append((start, stop, bool(inside)))
        at = stop
    return pieces


@pytest.mark.parametrize("seed", range(3))
def test_pieces_against_plain_greedy(spark, seed):
    rng = random.Random(seed)
    items = [("record", i, rng.randint(30, 900), sorted(rng.sample(range(1, 900), rng.choice([0, 1, 3, 12])))) for i in range(25)]
    items = [(k, i, n, [e for e in ends if e < n] or None) for k, i, n, ends in items] + [("genome", 1, 50000, None), ("record", 77, None, None), ("record", None, 500, None), ("record", 78, 40, [20])]
    df = spark.createDataFrame(items + items[:2], "kind string, id bigint, n bigint, ends array<int>").withColumn("piece", F.lit("clash"))
    got: dict = {}
    for r in p3_split.split_pieces(df, 40, 5).collect():
        got.setdefault((r.kind, r.id), []).append((r.piece, r.start, r.stop, r.natural))
    want = {(k, i): [(p + 1, *x) for p, x in enumerate(_greedy(n, ends or [], 40, 5))] for k, i, n, ends in items if n and i is not None and n > 40}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert all(b - a + 1 <= 40 for v in got.values() for _, a, b, _ in v)


def test_boundaries_against_a_plain_scan(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ACGTacgt" * 3, "N" * rng.randint(15, 30), "n-?" * 8, "ACGT"]) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["N" * 40, "", None, "ACGT" + "N" * 25, "N" * 25 + "ACGT"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(p3_split.boundary_ends(F.col("s"))).collect()]
    for t, g in zip(texts, got, strict=True):
        if t is None:
            assert g is None
        else:
            assert g == [m.end() for m in re.finditer("[^ACGTacgt]{20,}", t) if m.start() > 0 and m.end() < len(t)]


def test_no_items_to_split(spark):
    none = spark.createDataFrame([], "kind string, id bigint, n bigint, ends array<int>")
    assert p3_split.split_pieces(none).count() == 0
    with pytest.raises(ValueError):
        p3_split.successors(none, 10, 10)


def test_groups_and_shares(spark):
    rng = random.Random(4)
    rows = [(i, f"a{rng.randint(0, 150)}" if i % 9 else None, f"o{rng.randint(0, 400)}" if i % 5 else None) for i in range(400)]
    rows += [(1000 + i, "hot", None) for i in range(300)] + [(None, "a1", "o1"), rows[3]]
    df = spark.createDataFrame(rows, "k bigint, x string, y string").withColumn("node", F.lit("clash"))
    out = p4_splits.grouped_split(df, "k", ["x", "y"], bins=40).collect()
    parent: dict = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for k, x, y in rows:
        if k is not None:
            find(k)
            for v in (("x", x), ("y", y)):
                if v[1] is not None:
                    a, b = find(k), find(v)
                    parent[a] = b
    group: dict = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        group.setdefault(find(k), set()).add(k)
    low = {k: min(g) for g in group.values() for k in g}
    assert {r.k: r.group_key for r in out} == low and len(out) == len(low)
    split: dict = {}
    for r in out:
        assert split.setdefault(r.group_key, r.split) == r.split
    assert {r.split for r in out} == {"train", "validation", "test"}


def test_bins_are_balanced(spark):
    rng = random.Random(1)
    weights = [(i, rng.choice([1, 1, 1, 2, 3, 10])) for i in range(1500)]
    placed = p4_splits.balanced_bins(spark.createDataFrame(weights, "item bigint, weight bigint"), 20).collect()
    w, load = dict(weights), {}
    for r in placed:
        load[r.bin] = load.get(r.bin, 0) + w[r.item]
    assert len(placed) == 1500 and len(load) == 20 and max(load.values()) - min(load.values()) <= 12
    shares = p4_splits.allot(list(load.items()), p4_splits.TARGETS)
    train = sum(load[b] for b, s in shares.items() if s == "train") / sum(load.values())
    assert abs(train - 0.8) < 0.03


def test_nothing_to_group(spark):
    none = spark.createDataFrame([], "k bigint, x string")
    assert p4_splits.related_groups(none, "k", ["x"]).count() == 0
    assert p4_splits.grouped_split(none, "k", ["x"]).count() == 0


def test_found_boundaries_are_those_whose_chain_ends(spark, sf, monkeypatch):
    rng = random.Random(8)
    items = [("record", i, rng.randint(60, 900), sorted(rng.sample(range(1, 60), rng.choice([0, 1, 3, 12])))) for i in range(20)]
    df = spark.createDataFrame(items, "kind string, id bigint, n bigint, ends array<int>")
    got = {(r.id, r.at): r.end for r in p3_split.chain_ends(p3_split.successors(df, 40, 5)).collect()}
    assert got == {(i, at): n for _, i, n, ends in items for at in [0, *ends]}
    chains = p3_split.chain_ends
    monkeypatch.setattr(p3_split, "chain_ends", lambda t: chains(t).where("false"))
    assert p3_split.p3_found(spark, sf).count() == 0


def test_found_targets_come_from_the_sample(spark, sf, monkeypatch):
    want = sorted(tuple(r) for r in p2_sample.p2_found(spark, sf).collect())
    asked, draw = [], p2_sample.sample_to_targets
    monkeypatch.setattr(p2_sample, "sample_to_targets", lambda *a: asked.append(a) or draw(*a))
    assert sorted(tuple(r) for r in p2_sample.p2_found(spark, sf).collect()) == want and len(asked) == 2
