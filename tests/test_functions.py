from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.functions import seq as S
from strandloom.operators.kmers import word_counts
from strandloom.operators.vectors import word_domain


def test_coordinates_match_known_words(spark):
    known = {"TTAA": (1, 1), "TTAG": (1, 2), "TTAT": (1, 3), "TTAC": (1, 4), "TTTTTTTT": (1, 171), "CTATTCC": (34, 192)}
    df = spark.createDataFrame([(w,) for w in known], "w string")
    got = {r.w: (r.x, r.y) for r in df.select("w", S.word_x(F.col("w")).alias("x"), S.word_y(F.col("w")).alias("y")).collect()}
    assert got == known


@pytest.mark.parametrize(("k", "n"), [(4, 136), (5, 512), (6, 2080)])
def test_domain_sizes_and_inverse(spark, k, n):
    d = word_domain(spark, k)
    assert d.count() == n
    assert d.where(S.word_at(F.col("k"), F.col("x"), F.col("y")) != F.col("kmer")).count() == 0
    assert word_domain(spark, k, "whole").count() == 4**k


def test_even_words_swap_coordinates_on_the_other_strand(spark):
    d = word_domain(spark, 4, "whole").withColumn("rc", S.reverse_complement(F.col("kmer")))
    assert d.where((S.word_x(F.col("rc")) != F.col("y")) | (S.word_y(F.col("rc")) != F.col("x"))).count() == 0
    assert d.where(S.reverse_complement(F.col("rc")) != F.col("kmer")).count() == 0


def test_word_at_refuses_bad_coordinates(spark):
    df = spark.createDataFrame([(4, 0, 1), (4, 17, 1), (5, 1, 1), (None, 1, 1)], "k int, x int, y int")
    got = [r[0] for r in df.select(S.word_at(F.col("k"), F.col("x"), F.col("y"))).collect()]
    assert got[0] is None and got[1] is None and got[3] is None


def test_reverse_complement_and_nulls(spark):
    df = spark.createDataFrame([("acgtn-",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(S.reverse_complement(F.col("s"))).collect()] == ["NNACGT", "", None]


def test_levels_at_the_thresholds(spark):
    df = spark.createDataFrame([(3165, 1000000), (3166, 1000000), (4747, 1000000), (5986, 1000000), (5987, 1000000), (0, 10), (1, 0), (None, 5)], "c bigint, n bigint")
    assert [r[0] for r in df.select(L.level_of(4, F.col("c"), F.col("n"))).collect()] == [0, 1, 1, 2, 3, 0, None, None]
    with pytest.raises(ValueError):
        L.level_of(12, F.col("c"), F.col("n"))


def test_level_codes_without_leading_zeros(spark):
    df = spark.createDataFrame([("000",), ("0",), ("001",), ("1",), ("011",), ("11",), ("111",), (None,)], "c string")
    assert [r[0] for r in df.select(L.level_of_code(F.col("c"))).collect()] == [0, 0, 1, 1, 2, 2, 3, None]


def test_percentile_clamps(spark):
    df = spark.createDataFrame([(0.0,), (1e-9,), (1e12,)], "f double")
    assert [r[0] for r in df.select(L.percentile_of(F.col("f"), F.lit(4))).collect()] == [0.0, 0.0, 1.0]


def test_word_counts_against_plain_counting(spark):
    random.seed(5)
    rows = [(i, "".join(random.choice("ACGTacgtN \n") for _ in range(random.randint(0, 60)))) for i in range(30)] + [(100, None), (None, "ACGT"), (101, "")]
    for last in (True, False):
        got = {(r.id, r.k, r.kmer): (r.cnt, r.length) for r in word_counts(spark.createDataFrame(rows, "rid bigint, s string"), "rid", "s", (2, 3), include_last=last).collect()}
        want: dict = {}
        for i, s in rows:
            if i is None or s is None:
                continue
            t = "".join(s.split()).upper()
            for k in (2, 3):
                for a in range(len(t) - k + (1 if last else 0)):
                    w = t[a : a + k]
                    if set(w) <= set("ACGT"):
                        want[i, k, w] = (want.get((i, k, w), (0, 0))[0] + 1, len(t))
        assert got == want


def test_depletion_cases(spark):
    df = spark.createDataFrame([("AAACCCGGGTTT",), ("AC",), (None,)], "s string")
    assert [r[0] for r in df.select(S.deplete(F.col("s"), 12, 3)).collect()] == ["AAAC" + "CCGG" + "GTTT", "AG", None]
    # 12 letters, 6 kept in 2 chunks: gaps 2, 2, 2
    assert df.select(S.deplete(F.col("s"), 6, 2)).first()[0] == "ACC" + "ACC"
    with pytest.raises(ValueError):
        S.deplete(F.col("s"), 1, 2)


def test_substitutions_shifts_and_mismatches(spark):
    df = spark.createDataFrame([("ACG", "ACT"), ("AC", "TTACTT")], "a string, b string")
    rows = df.select(S.substitutions(F.col("a")).alias("s"), S.shifts(F.col("a")).alias("r"), S.shifts(F.col("a"), True).alias("l"), S.mismatches(F.col("a"), F.col("b")).alias("m"), S.windows(F.col("b"), 4).alias("w")).collect()
    assert len(rows[0].s) == 9 and "ACG" not in rows[0].s
    assert rows[0].r == ["CGA", "CGC", "CGG", "CGT"] and rows[0].l == ["AAC", "CAC", "GAC", "TAC"]
    assert [r.m for r in rows] == [1, 0] and rows[1].w == ["TTAC", "TACT", "ACTT"] and rows[0].w == []


def test_text_formats(spark):
    from strandloom.functions import text as X

    df = spark.createDataFrame([("Genus", "species", "strain 5", "ABC_123456789.1", 1.2399, 7.5, "12"), (None, "s", None, None, -1.2399, 11.0, "x")], "g string, s string, r string, a string, n double, v double, t string")
    r = df.select(X.short_genome(*(F.col(c) for c in "gsra")).alias("l"), X.truncated(F.col("n"), 2).alias("n"), X.text_level(F.col("v")).alias("v"), X.ranged(F.col("t"), 0, 20).alias("t"), X.file_name(F.lit("a b|c?")).alias("f")).collect()
    assert r[0].l == "G.species strain 5 [AB..." and r[1].l == ".s  []" and [x.n for x in r] == [1.23, -1.23]
    assert [x.v for x in r] == ["+++", None] and [x.t for x in r] == [12.0, None] and r[0].f == "a_b_c_"


def test_word_neighbourhoods(spark):
    from itertools import product

    from strandloom.functions import levels as V
    from strandloom.functions import seq as Z
    from strandloom.functions import text as X

    df = spark.createDataFrame([("ACGTA",), ("AAA",)], "w string")
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    for r in df.select("w", Z.words_at_distance(F.col("w"), 1, 2).alias("n"), Z.shifts_within(F.col("w"), 2).alias("s"), Z.deletions(F.col("w")).alias("d"), Z.extensions(F.col("w")).alias("e")).collect():
        every = ["".join(p) for p in product("ACGT", repeat=len(r.w))]
        assert r.n == [w for w in every if 1 <= far(w, r.w) <= 2]
        assert set(r.s) == {w for w in every if w[:-1] == r.w[1:] or w[:-2] == r.w[2:]}
        assert sorted(r.d) == sorted({r.w[:i] + r.w[i + 1 :] for i in range(len(r.w))}) and r.e == [r.w + c for c in "ACGT"]
    one = spark.createDataFrame([("NAn", "ACGT", "GTAC", "ACCA")], "n string, a string, b string, c string")
    r = one.select(Z.expanded(F.col("n")).alias("x"), Z.joined_words(F.col("a"), F.col("b")).alias("j"), Z.mismatch_places(F.col("a"), F.col("c")).alias("m")).first()
    assert sorted(r.x) == sorted(a + "A" + b for a in "ACGT" for b in "ACGT") and r.j == "ACGTAC" and r.m == [3, 4]
    a = spark.createDataFrame([([0, 1, 2],)], "l array<int>")
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    l = F.col("l")  # noqa: E741
    got = a.select(V.inserted(l, F.lit(1), F.lit(3)), V.inserted(l, F.lit(9), F.lit(3)), V.replaced(l, F.lit(2), F.lit(0)), V.without_places(l, lit(1, 3)), V.picked(l, lit(3, 1, 7)), V.merged(l, F.lit(None).cast("array<int>"))).first()
    assert [list(x) for x in got] == [[3, 0, 1, 2], [0, 1, 2, 3], [0, 0, 2], [1], [2, 0, None], [0, 1, 2]]
    t = spark.createDataFrame([("Yes",), (" 0 ",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in t.select(X.truth(F.col("t"))).collect()] == [True, False, None, None]
