"""Level vectors of word databases as long feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.functions.seq import word_x, word_y
from strandloom.operators.kmers import word_of_code
from strandloom.session import small


def word_domain(spark: SparkSession, k: int, geometry: str = "lower") -> DataFrame:
    """``(marker, kmer, k, x, y, pos)``: every word of length k that a geometry keeps, in the order of x and y from position 0."""
    L.check_k(k)
    words = spark.range(4**k).select(word_of_code(F.col("id"), k).alias("kmer")).select("kmer", F.lit(k).alias("k"), word_x(F.col("kmer")).alias("x"), word_y(F.col("kmer")).alias("y"))
    words = words.where({"lower": "x <= y", "upper": "x >= y", "whole": "true"}[geometry])
    pos = F.row_number().over(W.orderBy("x", "y")) - 1  # at most 4^k rows
    return words.withColumn("pos", pos).withColumn("marker", F.concat_ws("|", "kmer", F.col("k").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")))


def word_domain_size(k: int) -> int:
    """Words with x <= y: all palindromes of an even length and half of the rest."""
    return (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2


def taxon_form(taxon: Column) -> Column:
    """A genus name without case, blanks and a final ``sp.``; null for placeholders."""
    name = F.regexp_replace(F.regexp_replace(F.lower(taxon), r"\s+", ""), r"sp\.$", "")
    return F.when(~name.isin("", "none", "na", "nan", "-", "unknown"), name)


def vector_features(values: DataFrame, k: int = 4) -> DataFrame:
    """``(name, taxon, marker, pos, level, value)``: the entries of level vectors.

    An entry is a level code or a value -2..2; a missing or unreadable one is level 0, and so is one
    behind the end of a list that ends early. Rows with a null or empty list have no entries.
    """
    domain = word_domain(values.sparkSession, k).select("marker", "pos")
    rows = values.where(F.size("level_values") > 0).select(F.col("value_id").alias("name"), taxon_form(F.col("taxon")).alias("taxon"), "level_values")
    size = word_domain_size(k)
    cells = rows.select("name", "taxon", "level_values", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos"))
    cells = cells.select("name", "taxon", "pos", F.trim(F.get("level_values", F.col("pos"))).alias("code")).join(small(domain, 70_000), "pos")
    code = F.col("code")
    level = None
    for i, (a, b) in enumerate(zip(L.CODES, L.VALUES, strict=True)):
        hit = code.isin(a, str(b))
        level = F.when(hit, i) if level is None else level.when(hit, i)
    cells = cells.select("name", "taxon", "marker", "pos", F.coalesce(level, F.lit(0)).alias("level"))
    return cells.withColumn("value", L.on_scale(F.col("level"), L.VALUES))
