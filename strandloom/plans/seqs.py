"""Queries over sequences (fasta_records)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.functions import seq as S
from strandloom.functions.names import accession_form
from strandloom.operators import kmers
from strandloom.plans import sql
from strandloom.session import table, wide
from strandloom.sources.sequences import SPACER, concatenate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            SQL[name or f.__name__] = oracle
        return f

    return add


def seqs(spark, d):
    """Cleaned sequences with their record id and accession."""
    rows = table(spark, d, "fasta_records").where("seq is not null and record_id is not null")
    return rows.select("record_id", "accession", S.clean_seq(F.col("seq")).alias("seq"))


def _spectrum(k: int):
    def run(spark, d):
        c = kmers.word_counts(table(spark, d, "fasta_records"), "record_id", "seq", (k,))
        return kmers.group_spectrum(c)

    run.__doc__ = f"Counts of all words of {k} letters and the records that hold them (F3, A1)."
    return run


for _k in (4, 5, 6, 7):
    query(f"WITH {sql.SEQS}, {sql.counts(_k)} SELECT {_k}::INTEGER AS k, kmer, sum(cnt)::BIGINT AS cnt, count(*) AS sequences FROM counts{_k} GROUP BY kmer", f"kmer_spectrum_k{_k}")(_spectrum(_k))


@query(f"WITH {sql.SEQS}, {sql.counts(4, last=False)} SELECT kmer, sum(cnt)::BIGINT AS cnt FROM counts4 GROUP BY kmer")
def training_spectrum(spark, d):
    """Words of 4 letters counted as for training, without the word at the last position (Q1)."""
    c = kmers.word_counts(table(spark, d, "fasta_records"), "record_id", "seq", (4,), include_last=False)
    return c.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


_L4 = sql.level(4, "cnt", "length", L.THRESHOLDS[4])


@query(f"WITH {sql.SEQS}, {sql.counts(4)}, l AS (SELECT id, kmer, {_L4} AS level FROM counts4) SELECT kmer, count(*) AS n, " + ", ".join(f"count(*) FILTER (level = {i}) AS n{i}" for i in range(4)) + f", round(avg({sql.scale('level', L.VALUES)}), 6) AS mean_value FROM l GROUP BY kmer")
def abundance_levels(spark, d):
    """Levels of 4-letter words over all records that hold them, and their mean value."""
    c = kmers.word_counts(table(spark, d, "fasta_records"), "record_id", "seq", (4,))
    a = kmers.abundance(c, 4)
    each = [F.count_if(F.col("level") == i).alias(f"n{i}") for i in range(4)]
    return a.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), *each, F.round(F.avg(L.on_scale(F.col("level"), L.VALUES)), 6).alias("mean_value"))


_OLD4 = sql.level(4, "cnt", "length", L.THRESHOLDS_OLD[4])


@query(f"WITH {sql.SEQS}, {sql.counts(4)} SELECT {_L4} AS level, {_OLD4} AS old_level, count(*) AS n FROM counts4 GROUP BY ALL")
def threshold_versions(spark, d):
    """Entries by their level under the present and the older, wider thresholds."""
    c = kmers.word_counts(table(spark, d, "fasta_records"), "record_id", "seq", (4,))
    old = L.level_of(4, F.col("cnt"), F.col("length"), L.THRESHOLDS_OLD)
    return kmers.abundance(c, 4).groupBy("level", old.alias("old_level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {sql.SEQS} SELECT record_id, {sql.rc('seq')} AS rc FROM seqs")
def reverse_complement(spark, d):
    """Reverse complement of every sequence (F1)."""
    return wide(seqs(spark, d)).select("record_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(
    f"""WITH {sql.SEQS}, o AS (SELECT record_id, seq,
  list_sum(list_transform(range(1, len(seq)), lambda i: (substr(seq, i, 3) = 'ATG')::INT)) AS a, list_sum(list_transform(range(1, len(seq)), lambda i: (substr(seq, i, 3) = 'CAT')::INT)) AS b FROM seqs WHERE len(seq) >= 3)
SELECT record_id, a::INTEGER AS forward, b::INTEGER AS backward, greatest(a, b)::INTEGER AS most, least(a, b)::INTEGER AS least FROM o"""
)
def count_word(spark, d):
    """Overlapping occurrences of one word on both strands (F2, Q2)."""
    s, w = wide(seqs(spark, d).where(F.length("seq") >= 3)), F.lit("ATG")
    c = s.select("record_id", S.count_word(F.col("seq"), w).alias("forward"), S.count_word(F.col("seq"), S.reverse_complement(w)).alias("backward"))
    return c.select("record_id", "forward", "backward", F.greatest("forward", "backward").alias("most"), F.least("forward", "backward").alias("least"))


def _deplete_sql(target: int, chunks: int) -> str:
    part = "substr(seq, (i * size + least(i, more) + CASE WHEN gap > 0 THEN (i + 1) * space + least(i + 1, extra) ELSE 0 END + 1)::BIGINT, (size + (i < more)::INT)::BIGINT)"
    return f"""WITH {sql.SEQS}, g AS (SELECT record_id, seq, least(len(seq), {target}) AS kept, len(seq) - least(len(seq), {target}) AS gap FROM seqs),
  p AS (SELECT *, kept // {chunks} AS size, kept % {chunks} AS more, gap // {chunks + 1} AS space, gap % {chunks + 1} AS extra, unnest(range(0, {chunks})) AS i FROM g),
  c AS (SELECT record_id, i, CASE WHEN i % 2 = 1 THEN {sql.rc(part)} ELSE {part} END AS piece FROM p)
SELECT record_id, string_agg(piece, '' ORDER BY i) AS depleted FROM c GROUP BY record_id"""


@query(_deplete_sql(300, 5))
def deplete_sequence(spark, d):
    """300 bases of every sequence in 5 evenly spaced chunks, every second one reverse-complemented (G1)."""
    return wide(seqs(spark, d)).select("record_id", S.deplete(F.col("seq"), 300, 5).alias("depleted"))


@query(f"WITH {sql.SEQS} SELECT record_id, substr(seq || seq, (record_id % len(seq)) + 1, least(50, len(seq))) AS part, ((record_id % len(seq)) + least(50, len(seq))) % len(seq) AS stop FROM seqs WHERE len(seq) > 0")
def circular_slice(spark, d):
    """50 bases around the end of a circular sequence."""
    s = seqs(spark, d).where(F.length("seq") > 0)
    n = F.length("seq")
    start, size = F.pmod(F.col("record_id"), n), F.least(F.lit(50), n)
    return s.select("record_id", S.circular_slice(F.col("seq"), start, size).alias("part"), F.pmod(start + size, n).alias("stop"))


@query(f"WITH {sql.SEQS} SELECT {sql.acc()} AS acc, string_agg(seq, '{SPACER}' ORDER BY record_id, seq) AS seq FROM seqs WHERE accession IS NOT NULL GROUP BY ALL")
def concatenated_genomes(spark, d):
    """All records of an accession in one sequence, 50 N between them."""
    s = seqs(spark, d).where("accession is not null").withColumn("acc", accession_form(F.col("accession")))
    return concatenate(s, by="acc", order="record_id")


@query(f"WITH {sql.SEQS} SELECT seq, count(*) AS copies, min(record_id) AS record_id FROM seqs GROUP BY seq")
def dereplicated(spark, d):
    """Distinct sequences with the number of their copies."""
    return seqs(spark, d).groupBy("seq").agg(F.count(F.lit(1)).alias("copies"), F.min("record_id").alias("record_id"))


@query(f"WITH {sql.SEQS} SELECT record_id, len(seq) AS n, len(regexp_replace(seq, '[^GC]', '', 'g')) AS gc, len(regexp_replace(seq, '[ACGT]', '', 'g')) AS unknown FROM seqs WHERE len(seq) BETWEEN 500 AND 5000")
def sequence_profile(spark, d):
    """Length, G and C, and unknown letters of the sequences within length bounds."""
    s = seqs(spark, d).where(F.length("seq").between(500, 5000))
    left = lambda p: F.length(F.regexp_replace("seq", p, "")).cast("bigint")
    return s.select("record_id", F.length("seq").cast("bigint").alias("n"), left("[^GC]").alias("gc"), left("[ACGT]").alias("unknown"))


@query(f"WITH {sql.SEQS} SELECT record_id, len(seq) AS n, len(regexp_replace(seq, '[^GC]', '', 'g')) AS gc, len(regexp_replace(seq, '[ACGT]', '', 'g')) AS unknown FROM seqs")
def sequence_lengths(spark, d):
    """Length, G and C, and unknown letters of every sequence (F28 without bounds)."""
    left = lambda p: F.length(F.regexp_replace("seq", p, "")).cast("bigint")
    return seqs(spark, d).select("record_id", F.length("seq").cast("bigint").alias("n"), left("[^GC]").alias("gc"), left("[ACGT]").alias("unknown"))
