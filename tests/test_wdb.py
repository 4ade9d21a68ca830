from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import wdb

SCHEMA = "word_id bigint, accession string, k int, x int, y int, kmer string, cnt bigint, level_code string, counted_at timestamp, extra string"


def test_cleaning_takes_the_newest_row(spark):
    rows = [(1, "ZWB_1.1", 4, 1, 1, "ttaa", 5, "001", None, "x"), (2, " zwb1", 4, 1, 1, None, 7, "1", None, "y"), (3, None, 4, 1, 1, "TTAA", 1, "111", None, "z"), (4, "b", 4, 1, 2, None, 2, None, None, "")]
    got = {(r.acc, r.x, r.y): (r.kmer, r.cnt, r.level) for r in wdb.clean_words(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("zwb1", 1, 1): ("TTAA", 7, 1), ("b", 1, 2): ("TTAG", 2, None)}
    assert wdb.clean_words(spark.createDataFrame([], SCHEMA)).count() == 0


def _words(spark, rows):
    return spark.createDataFrame(rows, "acc string, k int, x int, y int, kmer string, cnt bigint, level int")


def test_scores_on_known_levels(spark):
    w = _words(spark, [(f"g{i}", 4, 1, 1, "TTAA", 1, lv) for i, lv in enumerate([0, 0, 3, 3])] + [("g0", 4, 1, 2, "TTAG", 1, 3), ("g1", 4, 1, 2, "TTAG", 1, None)])
    d = {r.kmer: r for r in wdb.divergency(w, "kmer").collect()}
    assert d["TTAA"].divergency == 10.0 and d["TTAA"].commonality == 5.0 and d["TTAG"].divergency == 0.0 and d["TTAG"].rareness == 0.0
    c = wdb.level_counts(w, "kmer").where("kmer = 'TTAA'").first()
    assert (c.n0, c.n3) == (2, 2)
    g = w.withColumn("grp", F.when(F.col("acc").isin("g0", "g1"), "low").otherwise("high"))
    s = wdb.confrontation(g, "grp", "low").where("kmer = 'TTAA'").first().score
    assert abs(s - 10.0) < 1e-9
    assert wdb.confrontation(g.limit(0), "grp", "low").count() == 0 and wdb.taxa_variance(g.limit(0), "grp").count() == 0


def test_registry_and_replacement(spark):
    w = _words(spark, [("b", 4, 1, 1, "TTAA", 1, 0), ("a", 4, 1, 1, "TTAA", 2, 1), ("a", 4, 1, 2, "TTAG", 2, 1)])
    assert {r.acc: r.genome_id for r in wdb.genome_ids(w).collect()} == {"a": 1, "b": 2}
    new = _words(spark, [("a", 4, 1, 3, "TTAT", 9, 3)])
    assert {(r.acc, r.kmer) for r in wdb.replace_genome(w, new).collect()} == {("b", "TTAA"), ("a", "TTAT")}
    kept = wdb.without_dominated(spark.createDataFrame([("AAAA", 5), ("AAAC", 9), ("CGCG", 9)], "kmer string, score int"), "score")
    assert {r.kmer for r in kept.collect()} == {"AAAC", "CGCG"}


def test_folders_follow_the_tree(spark, tmp_path):
    from strandloom.sources.wdb import write_folders

    words = _words(spark, [(a, 4, 1, 1, "TTAA", 1, 0) for a in ("a", "b", "c", "d")])
    paths = spark.createDataFrame([("a", "Root>0>1>a"), ("b", "Root>0>1>b"), ("c", "Root>c"), ("e", None)], "acc string, path string")
    write_folders(words, paths, str(tmp_path / "t"))
    got = {(r.acc, str(r.folder)) for r in spark.read.option("recursiveFileLookup", False).parquet(str(tmp_path / "t")).collect()}
    assert got == {("a", "0_1"), ("b", "0_1"), ("c", "root")}


def test_merge_and_delete(spark):
    from strandloom.operators import wdb as D

    a = spark.createDataFrame([("g1", 4, 1, 1, "TTAA", 2), ("g2", 4, 1, 1, "TTAA", 5)], "acc string, k int, x int, y int, kmer string, cnt bigint")
    b = spark.createDataFrame([("g1", 4, 1, 1, "TTAA", 3), ("g3", 4, 1, 2, "TTAG", 1)], "acc string, k int, x int, y int, kmer string, cnt bigint")
    assert {(r.acc, r.kmer, r.cnt) for r in D.merge_databases(a, b).collect()} == {("g1", "TTAA", 5), ("g2", "TTAA", 5), ("g3", "TTAG", 1)}
    ids = D.delete_genomes(D.genome_ids(D.merge_databases(a, b)), spark.createDataFrame([("g2",)], "acc string"))
    assert {(r.acc, r.genome_id) for r in ids.collect()} == {("g1", 1), ("g3", 2)}
    found = {(r.kmer, r.acc, r.cnt, r.rc_cnt) for r in D.lookup(b, spark.createDataFrame([("TTAA",), ("CTAA",), (None,)], "kmer string")).collect()}
    assert found == {("TTAA", "g1", 3, 3), ("CTAA", "g3", 0, 1)}
    assert {(r.acc, r.kmer) for r in D.pop_words(b, a)[1].collect()} == {("g3", "TTAG")}
    top = D.without_repeats(spark.createDataFrame([("AAC", 3.0), ("GTT", 2.0), ("CCC", 1.0)], "kmer string, v double"), "v", 5).collect()
    assert [r.kmer for r in top] == ["AAC", "CCC"]
