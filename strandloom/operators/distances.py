"""Distances between level vectors by an equi-join on words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_distances(levels: DataFrame, most_names: int = 5_000) -> DataFrame:
    """``(a, b, d)``, a < b: thermometer Hamming distance of two vectors over all words, / (3 * words).

    |p - q| = p + q - 2 min(p, q), so d = (S_a + S_b - 2 sum min) / (3 W): only words that both have above
    level 0 must meet, in an inner equi-join. ``levels(name, marker, level)`` with one row per name and marker; absent
    and null levels are 0. A distance matrix is quadratic in the names by definition, so more than ``most_names`` are refused.
    """
    known = levels.where("name is not null and level is not null")
    names = known.groupBy("name").agg(F.sum("level").alias("s"))
    n = names.limit(most_names + 1).count()
    if n > most_names:
        raise ValueError(f"more than {most_names} names: cluster or sample them first")
    words = known.agg(F.countDistinct("marker").alias("w"))
    some = known.where("level > 0").select("name", "marker", "level")
    b = some.select(F.col("name").alias("b"), "marker", F.col("level").alias("lb"))
    both = some.withColumnsRenamed({"name": "a", "level": "la"}).join(b, "marker").where("a < b").groupBy("a", "b").agg(F.sum(F.least("la", "lb")).alias("m"))
    left, right = names.select(F.col("name").alias("a"), F.col("s").alias("sa")), names.select(F.col("name").alias("b"), F.col("s").alias("sb"))
    pairs = F.broadcast(left).join(F.broadcast(right), F.col("a") < F.col("b"))  # at most `most_names` rows each
    d = (F.col("sa") + F.col("sb") - 2 * F.coalesce("m", F.lit(0))) / (3 * F.col("w"))
    return pairs.join(both, ["a", "b"], "left").crossJoin(F.broadcast(words)).select("a", "b", d.cast("double").alias("d"))


def average_linkage(distances: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean distance between clusters: ``distances(a, b, d)``, ``clusters(name, cluster)``."""
    of = lambda s: clusters.select(F.col("name").alias(s), F.col("cluster").alias(f"c{s}"))
    both = distances.join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
    return both.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.avg("d").alias("d"))
