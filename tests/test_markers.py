from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import markers as M


def feats(spark, rows):
    return spark.createDataFrame(rows, "name string, taxon string, marker string, value int")


def test_chi_square_plain_and_corrected(spark):
    rows = [(f"a{i}", "a", "m", 1 if i < 7 else 2) for i in range(10)] + [(f"b{i}", "b", "m", 1 if i < 2 else 2) for i in range(10)]
    rows += [(f"c{i}", "abc"[i % 3], "w", [-2, -1, 1, 2][(i * i) % 4]) for i in range(40)] + [("x", "a", "one", 1), ("y", "b", "one", 1), ("z", None, "m", 1)]
    got = {r.marker: r for r in M.chi_square(feats(spark, rows)).collect()}
    # 2 x 2 with continuity correction: n (|ad - bc| - n/2)^2 / margins
    want = 20 * (abs(7 * 8 - 3 * 2) - 10) ** 2 / (10 * 10 * 9 * 11)
    assert got["m"].dof == 1 and math.isclose(got["m"].chi2, want, rel_tol=1e-9)
    cells: dict = {}
    for _, t, m, v in rows:
        if m == "w":
            cells[t, v] = cells.get((t, v), 0) + 1
    labels, values = sorted({t for t, _ in cells}), sorted({v for _, v in cells})
    chi = 0.0
    for t in labels:
        for v in values:
            r, c = sum(cells.get((t, u), 0) for u in values), sum(cells.get((s, v), 0) for s in labels)
            chi += (cells.get((t, v), 0) - r * c / 40) ** 2 / (r * c / 40)
    assert math.isclose(got["w"].chi2, chi, rel_tol=1e-9)
    assert got["one"].chi2 is None


@pytest.mark.parametrize("dof", [1, 2, 3, 5, 6, 9])
def test_tail_against_integration(dof):
    x = 4.2
    f = lambda t: t ** (dof / 2 - 1) * math.exp(-t / 2) / (2 ** (dof / 2) * math.gamma(dof / 2))
    n, top = 200_000, 160.0
    h = (top - x) / n
    total = sum(f(x + (i + 0.5) * h) for i in range(n)) * h
    assert math.isclose(M.chi_square_tail(x, dof), total, rel_tol=1e-5)
    assert M.chi_square_tail(0.0, dof) == pytest.approx(1.0)


def test_fdr_rank_and_selection(spark):
    p = [0.001, 0.04, 0.03, 0.5, None, 0.04]
    df = spark.createDataFrame([(f"W{i}|{4 + i % 2}|1|1", x) for i, x in enumerate(p)] + [("bad", 0.2)], "marker string, p double")
    out = M.rank_markers(M.with_fdr(df)).orderBy("rank").collect()
    valid = sorted(x for x in [*p, 0.2] if x is not None)
    want, low = {}, 1.0
    for i in range(len(valid) - 1, -1, -1):
        low = min(low, valid[i] * len(valid) / (i + 1))
        want[valid[i]] = low
    assert all(r.p is None and r.fdr is None or math.isclose(r.fdr, want[r.p]) for r in out)
    assert out[-1].p is None and out[0].p == 0.001
    ranked = M.rank_markers(M.with_fdr(df))
    assert [r.rank for r in M.select_ranked(ranked, least=3, most=10).orderBy("rank").collect()] == [1, 2, 3]
    assert M.select_ranked(ranked, p_value=None, significant=False, least=1, most=2).count() == 2


def test_selection_by_mean_falls_back(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.7), ("c", -0.7), ("d", 1.5), ("e", None)], "marker string, mean double")
    got = {r.marker: (r.is_diverse, r.is_common) for r in M.select_by_mean(df, least=0).collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (False, False), "d": (False, True)}
    got = {r.marker for r in M.select_by_mean(df, least=2).where("is_diverse").collect()}
    assert got == {"a", "b"}
    with pytest.raises(ValueError):
        M.select_by_mean(df, diverse=(1, 0))


def test_children_summary_pads_and_relabels(spark):
    rows = [("n1", "g1", "s", "m1", 1), ("n1", "g1", "s", "m2", 2), ("n2", "g2", "s", "m1", -1), ("n2", "g2", "s", "m3", -2)]
    f = spark.createDataFrame(rows, "node string, name string, taxon string, marker string, value int")
    parents = spark.createDataFrame([("n1", "p", "left"), ("n2", "p", "right")], "node string, parent string, title string")
    got = {(r.name, r.taxon, r.marker): r.value for r in M.summarize_children(f, parents, top=1).collect()}
    assert got == {("g1", "left", "m1"): 1, ("g1", "left", "m2"): 2, ("g1", "left", "m3"): 0, ("g2", "right", "m1"): -1, ("g2", "right", "m2"): 0, ("g2", "right", "m3"): -2}


def test_empty_features(spark):
    none = feats(spark, [])
    assert M.chi_square(none).count() == 0 and M.marker_means(none).count() == 0 and M.padding_markers(none, 3).count() == 0
    assert M.median_cluster(none).count() <= 1


def test_fdr_is_monotone(spark):
    random.seed(1)
    df = spark.createDataFrame([(f"m{i}", random.random()) for i in range(60)], "marker string, p double")
    out = M.with_fdr(df).orderBy("p").select("p", "fdr").collect()
    assert all(a.fdr <= b.fdr + 1e-12 for a, b in zip(out, out[1:], strict=False)) and all(r.fdr >= r.p - 1e-12 for r in out)
    assert M.with_p_values(spark.createDataFrame([("m", 3.0, 2)], "marker string, chi2 double, dof bigint")).select(F.round("p", 6)).first()[0] == round(math.exp(-1.5), 6)


def test_cleaning_and_variance_scores(spark):
    rows = [(" g ", "m", " 2 ", "x"), ("g", "m", "bad", "x"), ("", "m", "1", "x"), (None, "m", "1", "x"), ("NaN", "m", "1", "x"), ("g", "m", None, "x")]
    clean = M.clean_features(spark.createDataFrame(rows, "taxon string, marker string, value string, extra string"), "taxon", "value")
    assert sorted((r.taxon, r.value) for r in clean.collect()) == [("g", 0), ("g", 0), ("g", 2)]
    values = [("m", 2), ("m", 1), ("n", -1), ("n", 1), ("o", 1), ("p", None)]
    got = {r.marker: r.score for r in M.variance_scores(spark.createDataFrame(values, "marker string, value int")).collect()}
    assert got == {"m": -0.5, "n": 2.0, "o": None, "p": None}


def test_whole_value_matrix_has_every_word_of_the_vectors(spark, sf):
    from strandloom.operators.vectors import vector_features
    from strandloom.plans import registry
    from strandloom.session import table

    wide = registry.QUERIES["whole_value_matrix"](spark, sf)
    assert len(wide.columns) == 1 + 136
    long = {(r["name"], f"m{r.pos}"): r.value for r in vector_features(table(spark, sf, "wdb_values")).collect()}
    assert {(r["name"], c): r[c] for r in wide.collect() for c in wide.columns[1:]} == long
