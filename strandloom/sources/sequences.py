"""FASTA, FASTQ and GenBank files as DataFrames ``(read_id, description, seq, source_file)``, and writers.

Files are split by record, not by file: the text source cuts at the record separator, so one large file is
read by many tasks. Compressed files work by their suffix (a gzip file is one task by its nature).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.ranking import global_rank
from strandloom.session import small

# Suffixes of the formats; a compression suffix may follow.
FASTA = ("fa", "fsa", "fas", "fst", "fna", "fasta")
FASTQ = ("fq", "fastq")
GENBANK = ("gbk", "gb", "gbf", "gbff")
SPACER = "N" * 50


def format_of(path: str) -> str:
    """fasta, fastq or genbank by suffix (any case, with or without .gz); ValueError for others."""
    m = re.search(r"\.([a-z]+)(?:\.gz)?$", path.lower())
    for name, known in (("fasta", FASTA), ("fastq", FASTQ), ("genbank", GENBANK)):
        if m and m[1] in known:
            return name
    raise ValueError(f"no known sequence format: {path}")


def _blocks(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    rows = spark.read.option("lineSep", sep).text(paths if isinstance(paths, list) else [paths])
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    place = F.struct(F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row"))  # rows of a file's block follow each other
    return rows.select(F.replace("value", F.lit("\r"), F.lit("")).alias("value"), name.alias("source_file"), F.input_file_name().alias("file"), place.alias("at"))


def read_fasta(spark: SparkSession, paths: str | list[str], check: bool = True) -> DataFrame:
    """Records of FASTA files; blank lines are skipped, a header without sequence has an empty one.

    With ``check`` a file whose first text is no header is an error, found by a first pass over the files, else that text becomes a header.
    """
    rows = _blocks(spark, paths, "\n>")
    if check:
        # a file's first block still has its '>', or is blank and lost it to the separator
        begin = rows.groupBy("file").agg(F.min_by(F.substr(F.trim(F.regexp_replace("value", r"^\s+", "")), F.lit(1), F.lit(1)), "at").alias("c"))
        bad = begin.where(~F.col("c").isin("", ">")).limit(1).collect()
        if bad:
            raise ValueError(f"sequence before the first header in {bad[0]['file']}")
    rows = rows.where(F.trim("value") != "")
    first = F.col("value").startswith(">")
    value = F.when(first, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    rows = rows.withColumn("value", value)
    lines = F.split("value", "\n")
    header = F.trim(lines[0])
    seq = F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s+", "")
    return rows.select(F.split(header, r"\s+")[0].alias("read_id"), header.alias("description"), seq.alias("seq"), "source_file").where("description <> ''")


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of four-line FASTQ files with their ``quality``; blank lines are skipped.

    A line's place in its file tells what it is, as a quality line may begin like a header. Places are
    distributed ranks, so a large file is no single task. A file whose lines do not come in fours of the right kind is an error.
    """
    rows = spark.read.text(paths if isinstance(paths, list) else [paths]).where("trim(value) <> ''")
    rows = rows.select("value", F.input_file_name().alias("f"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("at"))
    ranked = global_rank(rows, [F.col("f"), F.col("b"), F.col("at")], "r")
    begun = ranked.groupBy("f").agg(F.min("r").alias("r0"))
    numbered = ranked.join(small(begun), "f").withColumn("n", F.col("r") - F.col("r0"))
    rec = numbered.groupBy("f", F.floor(F.col("n") / 4).alias("rec")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.rtrim("value"))).alias(c) for i, c in enumerate(("h", "seq", "plus", "quality"))])
    header = F.substr("h", F.lit(2))
    bad = ~F.col("h").startswith("@") | ~F.coalesce(F.col("plus").startswith("+"), F.lit(False))
    rec = rec.withColumn("h", F.when(bad, F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.col("h")))).otherwise(F.col("h")))
    return rec.select(F.split(header, r"\s+")[0].alias("read_id"), header.alias("description"), "seq", "quality", F.element_at(F.split("f", "/"), -1).alias("source_file"))


def read_genbank(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(accession, organism, lineage, seq, source_file)`` of GenBank records (cut at the // line).

    lineage is taxonomy|organism|accession; the source line stands in where there is no ORGANISM.
    """
    rows = _blocks(spark, paths, "\n//").where("value like '%LOCUS%'")
    v = F.col("value")
    accession = F.coalesce(F.nullif(F.regexp_extract(v, r"(?m)^VERSION\s+(\S+)", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"(?m)^ACCESSION\s+(\S+)", 1), F.lit("")), F.regexp_extract(v, r"LOCUS\s+(\S+)", 1))
    organism = F.trim(F.coalesce(F.nullif(F.regexp_extract(v, r"(?m)^  ORGANISM\s+(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"(?m)^SOURCE\s+(.+)$", 1), F.lit(""))))
    taxa = F.regexp_extract(v, r"(?m)^  ORGANISM\s+.+\n((?:\s{12}.+\n?)*)", 1)
    taxa = F.filter(F.transform(F.split(F.regexp_replace(taxa, r"\.\s*$", ""), ";"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    seq = F.upper(F.regexp_replace(F.regexp_extract(v, r"(?ms)^ORIGIN[^\n]*\n(.*)", 1), r"[^A-Za-z]", ""))
    rows = rows.select(accession.alias("accession"), organism.alias("organism"), taxa.alias("taxa"), seq.alias("seq"), "source_file")
    return rows.select("accession", "organism", F.array_join(F.concat("taxa", F.array("organism", "accession")), "|").alias("lineage"), "seq", "source_file")


def concatenate(records: DataFrame, by: str = "source_file", seq: str = "seq", order: str = "read_id") -> DataFrame:
    """One sequence per ``by``: its records in order, joined by 50 N."""
    parts = F.array_sort(F.collect_list(F.struct(order, seq)))
    return records.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p[seq]), SPACER).alias("seq"))


def read_sequences(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All files of a format in a folder, by suffix in any case, compressed or not."""
    known = {"fasta": FASTA, "fastq": FASTQ, "genbank": GENBANK}[kind]
    either = lambda s: "".join(f"[{c}{c.upper()}]" for c in s)
    glob = "*.{" + ",".join(f"{either(s)},{either(s)}.gz" for s in known) + "}"
    return {"fasta": read_fasta, "fastq": read_fastq, "genbank": read_genbank}[kind](spark, f"{folder}/{glob}")


def fasta_text(description: Column, seq: Column) -> Column:
    """A FASTA record."""
    return F.concat(F.lit(">"), description, F.lit("\n"), seq)


def fastq_text(description: Column, seq: Column, quality: Column) -> Column:
    """A FASTQ record."""
    return F.concat(F.lit("@"), description, F.lit("\n"), seq, F.lit("\n+\n"), quality)


def write_records(rows: DataFrame, text: Column, path: str, compression: str | None = None) -> None:
    """One record per row as text files; existing output is replaced as a whole."""
    rows.select(text.alias("value")).write.mode("overwrite").text(path, compression=compression)
