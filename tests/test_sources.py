from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from strandloom.sources import sequences as Q
from strandloom.sources import wdb as W


def test_fasta_variants(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 first one\nACGT\nAC GT\n\n>r2\n\n>r3 last\r\nTT\r\nGG\r\n")
    with gzip.open(tmp_path / "b.FA.gz".replace("FA", "fa"), "wt") as f:
        f.write(">z only\nNNACGT\n")
    got = {r.read_id: (r.description, r.seq) for r in Q.read_sequences(spark, str(tmp_path), "fasta").collect()}
    assert got == {"r1": ("r1 first one", "ACGTACGT"), "r2": ("r2", ""), "r3": ("r3 last", "TTGG"), "z": ("z only", "NNACGT")}
    (tmp_path / "bad.fna").write_text("ACGT\n>r\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        Q.read_fasta(spark, str(tmp_path / "bad.fna")).collect()


def test_fasta_and_fastq_round_trip(spark, tmp_path):
    rows = [(f"r{i} x", "ACGT" * (i % 5 + 1), "@" + "I" * (4 * (i % 5 + 1) - 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "d string, s string, q string")
    Q.write_records(df, Q.fasta_text(F.col("d"), F.col("s")), str(tmp_path / "fa"), "gzip")
    got = Q.read_fasta(spark, str(tmp_path / "fa") + "/*.gz").collect()
    assert sorted((r.description, r.seq) for r in got) == sorted((d, s) for d, s, _ in rows)
    Q.write_records(df, Q.fastq_text(F.col("d"), F.col("s"), F.col("q")), str(tmp_path / "fq"))
    got = Q.read_fastq(spark, str(tmp_path / "fq") + "/*.txt").collect()
    assert sorted((r.description, r.seq, r.quality) for r in got) == sorted(rows)
    (tmp_path / "x.fq").write_text("not\na\nfastq\nfile\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        Q.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_genbank(spark, tmp_path):
    text = "LOCUS       AB1 12 bp\nACCESSION   AB1\nVERSION     AB1.2\nSOURCE      Genus one\n  ORGANISM  Genus one strain 5\n            Bacteria; Phylum;\n            Genus.\nFEATURES\nORIGIN\n        1 acgtac gtacgt\n//\nLOCUS       AB2\nSOURCE      Other thing\nORIGIN\n        1 ttt\n//\n"
    (tmp_path / "g.GBK").write_text(text)
    got = {r.accession: (r.organism, r.lineage, r.seq) for r in Q.read_sequences(spark, str(tmp_path), "genbank").collect()}
    assert got["AB1.2"] == ("Genus one strain 5", "Bacteria|Phylum|Genus|Genus one strain 5|AB1.2", "ACGTACGTACGT")
    assert got["AB2"] == ("Other thing", "Other thing|AB2", "TTT")


def test_formats_and_concatenation(spark):
    assert [Q.format_of(p) for p in ("a.FASTA", "b.fq.gz", "c.gbff")] == ["fasta", "fastq", "genbank"]
    with pytest.raises(ValueError):
        Q.format_of("x.txt")
    df = spark.createDataFrame([("b", "GG", "f"), ("a", "AA", "f")], "read_id string, seq string, source_file string")
    assert Q.concatenate(df).first().seq == "AA" + "N" * 50 + "GG"


def test_wdb_round_trips(spark, tmp_path):
    rows = [("g1", 4, 1, 1, "TTAA", 5, 2), ("g2", 4, 1, 1, "TTAA", 3, None), ("g1", 5, 2, 9, "CTATT", 1, 0)]
    df = spark.createDataFrame(rows, "acc string, k int, x int, y int, kmer string, cnt bigint, level int")
    W.save_wdb(df, str(tmp_path / "db"), "title")
    assert W.load_wdb(spark, str(tmp_path / "db"), 5, 5).count() == 1
    assert W.wdb_metadata(spark, str(tmp_path / "db")).first().geometry == "lower"
    assert W.wdb_metadata(spark, str(tmp_path / "no")).first().geometry == "whole"
    W.write_wdb_text(df, str(tmp_path / "t"), "title")
    got = sorted((r.kmer, r.k, r.cnt, r.acc, -1 if r.level is None else r.level) for r in W.read_wdb_text(spark, str(tmp_path / "t")).collect())
    assert got == [("CTATT", 5, 1, "g1", 0), ("TTAA", 4, 8, "g1", 2), ("TTAA", 4, 8, "g2", -1)]


def test_matrix_round_trip(spark, tmp_path):
    rows = [("a", "t", "m1", 1), ("a", "t", "m2", -2), ("b", "u", "m1", 2)]
    df = spark.createDataFrame(rows, "Name string, Taxon string, marker string, value int")
    W.write_matrix(df, ["Name", "Taxon"], str(tmp_path / "m"))
    got = {(r.Name, r.Taxon, r.marker): r.value for r in W.read_matrix(spark, str(tmp_path / "m"), ["Name", "Taxon"]).collect()}
    assert got == {("a", "t", "m1"): 1, ("a", "t", "m2"): -2, ("b", "u", "m1"): 2, ("b", "u", "m2"): 0}
    hits = spark.createDataFrame([("r", "t", 0.5, "p", True)], "record string, taxon string, identity double, path string, species_level boolean")
    W.write_hits(hits, str(tmp_path / "h"))
    assert "r\tt\t0.5000\tp\ttrue" in "".join(p.read_text() for p in (tmp_path / "h").glob("*.csv"))
    model = spark.createDataFrame([("n", "m", "b", 1.0), ("n", "m", "a", -0.25)], "node string, marker string, label string, mean double")
    assert W.model_text(model).first().value == "n\tm\ta=-0.2500\tb=1.0000"


def test_sections_and_range_of_a_text_database(spark, tmp_path):
    rows = [("g1", 4, 1, 1, "TTAA", 5, 2), ("g2", 4, 1, 1, "TTAA", 3, None), ("g1", 5, 2, 9, "CTATT", 1, 0), ("g3", 6, 2, 9, "CTATTA", 1, 0)]
    df = spark.createDataFrame(rows, "acc string, k int, x int, y int, kmer string, cnt bigint, level int")
    lineages = spark.createDataFrame([("g1", "a|b|g1"), ("g2", "a|c|g2")], "acc string, lineage string")
    W.write_wdb_text(df, str(tmp_path / "t"), "my title", "2", min_k=4, max_k=5, supplementary="a note", lineages=lineages)
    got = {(r.section, r.value) for r in W.read_wdb_sections(spark, str(tmp_path / "t")).collect()}
    assert got == {("title", "my title"), ("version", "2"), ("supplementary", "a note"), ("lineages", "g1|a|b|g1"), ("lineages", "g2|a|c|g2"), ("accessions", "g1"), ("accessions", "g2")}
    assert {r.k for r in W.read_wdb_text(spark, str(tmp_path / "t")).collect()} == {4, 5}


def test_matrices_of_every_length_and_chunks(spark, tmp_path):
    rows = [("a", "t", 4, f"m{i}", i % 3 - 1) for i in range(5)] + [("b", "u", 4, "m1", 2), ("a", "t", 5, "n", 1)]
    df = spark.createDataFrame(rows, "Name string, Taxon string, k int, marker string, value int")
    W.write_kmer_matrices(df, ["Name", "Taxon"], str(tmp_path), 4, 7, columns=3)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["4_mers.0", "4_mers.1", "5_mers.0"]
    cells = {(r.Name, r.marker): r.value for r in W.read_matrix(spark, str(tmp_path / "4_mers.0"), ["Name", "Taxon"]).collect()}
    assert cells == {("a", "m0"): -1, ("a", "m1"): 0, ("a", "m2"): 1, ("b", "m0"): -2, ("b", "m1"): 2, ("b", "m2"): -2}
    values = spark.createDataFrame([("a", i, i * i) for i in range(7)], "name string, pos int, value int")
    assert [(r.first, r.last, list(r.values_)) for r in W.genome_chunks(values, 3).withColumnRenamed("values", "values_").orderBy("first").collect()] == [(0, 2, [0, 1, 4]), (3, 5, [9, 16, 25]), (6, 6, [36])]
    texts = spark.createDataFrame([(i, "x" * 10) for i in range(20)] + [(20, None)], "i int, t string")
    sizes = W.sized_chunks(texts, "t", ["i"], 35).groupBy("chunk").count().collect()
    assert sum(r["count"] for r in sizes) == 21 and max(r["count"] for r in sizes) <= 5


def test_every_file_must_begin_with_a_header(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one\nACGT\n>two\nAC\n")
    (tmp_path / "b.fa").write_text("ACGTACGT\n>three\nAC\n")
    (tmp_path / "c.fa").write_text("\n\n>four\nAC\n")
    with pytest.raises(ValueError, match="b.fa"):
        Q.read_fasta(spark, [str(tmp_path / n) for n in ("a.fa", "b.fa", "c.fa")])
    assert {r.read_id for r in Q.read_fasta(spark, [str(tmp_path / n) for n in ("a.fa", "c.fa")]).collect()} == {"one", "two", "four"}
