from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.seq import reverse_complement
from strandloom.operators import classify as C
from strandloom.operators import models
from strandloom.streaming.classify import classify_stream


def _dna(n, seed):
    random.seed(seed)
    return "".join(random.choice("ACGT") for _ in range(n))


def _toy_model(spark):
    markers = spark.createDataFrame([("AAAA|4|0|0", "AAAA"), ("CCCC|4|0|0", "CCCC")], "marker string, kmer string")
    model = spark.createDataFrame([(m, t, v) for t, a, c in (("poly_a", 2.0, -2.0), ("poly_c", -2.0, 2.0)) for m, v in (("AAAA|4|0|0", a), ("CCCC|4|0|0", c))], "marker string, label string, mean double")
    return markers, model


def test_agreement_is_strand_invariant(spark):
    markers, model = _toy_model(spark)
    df = spark.createDataFrame([(1, "A" * 40 + _dna(60, 1)), (2, "G" * 40 + _dna(60, 2)), (3, None), (4, "AC")], "i bigint, s string")
    score = lambda d: {(r.id, r.label): r.score for r in C.agreement(C.read_marker_values(d, "i", "s", markers, (4,)), model).collect()}
    got = score(df)
    assert got[1, "poly_a"] > got[1, "poly_c"] and got[2, "poly_c"] > got[2, "poly_a"] and all(0 <= v <= 1 for v in got.values())
    assert got == score(df.withColumn("s", reverse_complement(F.col("s")))) and {i for i, _ in got} == {1, 2}


def test_descent_and_best_hits(spark):
    values = spark.createDataFrame([(1, "m", 2), (2, "m", 0)], "id bigint, marker string, value int")
    model = spark.createDataFrame([("root", "m", "a", 2.0), ("root", "m", "b", -2.0), ("a", "m", "a1", 2.0), ("a", "m", "a2", -1.0), ("b", "m", "b1", -2.0)], "node string, marker string, label string, mean double")
    edges = spark.createDataFrame([("root", "a", "a"), ("root", "b", "b"), ("a", "a1", None), ("a", "a2", None), ("b", "b1", None)], "node string, label string, child string")
    hits = C.descend(values, model, edges, accuracy=0.6, specificity=0.9)
    got = {(r.id, r.taxon, r.path, r.species_level, round(r.identity, 2)) for r in hits.collect()}
    assert got == {(1, "a", "Root", False, 1.0), (1, "a1", "Root.a", True, 1.0), (2, "root", "Root", False, 0.0)}
    best = {(r.id, r.taxon) for r in C.best_hits(hits, "id", "identity", "path", "species_level", "taxon").collect()}
    assert best == {(1, "a1"), (2, "root")}


def test_probability_report(spark):
    df = spark.createDataFrame([("x", "1", 0.5808236859196959), ("x", "0", 0.4191763140803041), ("y", "1", 1.0), ("y", "0", 0.0)], "n string, label string, p double")
    got = {(r.n, r.label): (round(r.odds_gap, 4), round(r.entropy, 4)) for r in C.probability_report(df, "n", "p").collect()}
    assert got["x", "0"] == (0.6639, 0.9811) and got["x", "1"][0] == 1.0 and got["y", "0"] == (10.0, 0.0)


def test_normalised_values(spark):
    df = spark.createDataFrame([(3.0,), (-9.0,), (float("nan"),), (float("inf"),), (None,), (0.5,)], "v double")
    assert [r[0] for r in df.select(C.normalised_value(F.col("v"))).collect()] == [2.0, -2.0, 0.0, 0.0, 0.0, 0.5]


def test_stream_equals_batch(spark, tmp_path):
    markers, model = _toy_model(spark)
    df = spark.createDataFrame([(i, "AC"[i % 2] * 30 + _dna(40, i)) for i in range(20)], "record_id bigint, seq string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    classify_stream(spark, str(tmp_path / "in"), "record_id bigint, seq string", markers, model, (4,), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_trigger=2).awaitTermination(120)
    got = {(r.id, r.label, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.id, r.label, r.score) for r in C.agreement(C.read_marker_values(df, "record_id", "seq", markers, (4,)), model).collect()}
    assert got == want and len(got) == 40


@pytest.mark.parametrize("kind", ["forest", "logistic", "perceptron"])
def test_models_learn_a_clear_split(spark, kind):
    rows = [(f"g{i}", "ab"[i % 2], f"m{m}|x", (2 if (i % 2) == (m % 2) else -2)) for i in range(40) for m in range(4)]
    f = spark.createDataFrame(rows, "name string, taxon string, marker string, value int")
    model, test = models.train_node(f, kind, trees=10)
    assert models.accuracy(test) == 1.0 and test.count() == 8
    p = models.class_probabilities(test, model)
    assert p.groupBy("name").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    assert models.train_node(f, kind, least_median=30) is None


def test_model_choice_and_quality(spark):
    rows = [(f"g{i}", "ab"[i % 2], f"m{m}|x", (2 if (i % 2) == (m % 2) else -2)) for i in range(30) for m in range(3)]
    f = spark.createDataFrame(rows, "name string, taxon string, marker string, value int")
    kind, scores = models.select_model(f, ("logistic", "svm"))
    assert kind in scores and min(scores.values()) == 1.0
    assert models.cluster_quality(f, 2) > 0.9
    s = models.class_statistics(f).first()
    assert (s.genomes, s.classes, s.balance, s.sparsity, s.missing) == (30, 2, 1.0, 0.0, 0.0)
    assert models.class_statistics(f.limit(0)).count() == 1


def test_product_score(spark):
    markers, model = _toy_model(spark)
    df = spark.createDataFrame([(1, "A" * 40 + _dna(60, 1))], "i bigint, s string")
    got = {r.label: r.score for r in C.product_score(C.read_marker_values(df, "i", "s", markers, (4,)), model).collect()}
    assert got["poly_a"] > got["poly_c"]
