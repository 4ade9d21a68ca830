"""Problem 4: train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.names import accession_key, organism_key
from strandloom.operators.graph import connected_components
from strandloom.operators.ranking import global_rank
from strandloom.session import cut_lineage, small, table

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def related_groups(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """``(id, group_key)`` for every id; group_key is the smallest id reached over equal keys.

    Null keys link nothing. Each key value becomes one star to its smallest id, so a key with
    a third of all rows costs its rows once. Rows with a null id are left out; repeated ids
    count once; no rows give no groups.
    """
    rows = rows.where(F.col(id_col).isNotNull())
    stars = []
    for key in keys:
        known = rows.where(F.col(key).isNotNull()).select(F.col(id_col).alias("a"), F.col(key).alias("k"))
        low = known.groupBy("k").agg(F.min("a").alias("b"))
        stars.append(known.join(low, "k").select("a", "b"))
    edges = stars[0]
    for star in stars[1:]:
        edges = edges.union(star)
    alone = rows.select(F.col(id_col).alias("a"), F.col(id_col).alias("b"))
    return connected_components(edges.union(alone)).select(F.col("node").alias(id_col), F.col("component").alias("group_key"))


def balanced_bins(weights: DataFrame, bins: int = 256) -> DataFrame:
    """``(item, bin)``: items folded into at most ``bins`` bins of nearly equal weight.

    Largest differencing in parallel rounds: items are ranked by weight and the heaviest is
    combined with the lightest, the second with the second lightest and so on; the sums are
    ranked again until ``bins`` remain. Every round halves the list with a distributed rank; only the
    first one combines no more of the lightest than leaves ``bins`` times a power of two.
    ``weights(item, weight)`` with one row per item; ties fall to the smaller item.
    """
    now = cut_lineage(weights.select(F.col("item").cast("bigint").alias("bin"), F.col("weight").cast("bigint").alias("weight")))
    placed = now.select(F.col("bin").alias("item"), "bin")
    n = now.count()
    while n > bins:
        aim = bins
        while 2 * aim < n:
            aim *= 2
        keep = 2 * aim - n
        ranked = global_rank(now, [F.desc("weight"), F.col("bin")], "r")
        ranked = ranked.withColumn("to", F.when(F.col("r") <= keep, F.col("r")).otherwise(F.least(F.col("r"), F.lit(keep + n + 1) - F.col("r"))))
        placed = cut_lineage(placed.join(ranked.select("bin", "to"), "bin").select("item", F.col("to").alias("bin")))
        now = cut_lineage(ranked.groupBy(F.col("to").alias("bin")).agg(F.sum("weight").alias("weight")))
        n = now.count()
    return placed


def allot(bins: list[tuple[int, int]], targets: dict[str, float]) -> dict[int, str]:
    """Bins, heaviest first, each to the split that lacks most of its target share."""
    total = sum(w for _, w in bins)
    lack = {s: share * total for s, share in targets.items()}
    out = {}
    for b, w in sorted(bins, key=lambda x: (-x[1], x[0])):
        split = max(lack, key=lambda s: (lack[s], s))
        lack[split] -= w
        out[b] = split
    return out


def grouped_split(rows: DataFrame, id_col: str, keys: list[str], targets: dict[str, float] = TARGETS, bins: int = 256) -> DataFrame:
    """``(id, group_key, split)``: rows linked by any key share a split.

    Groups are the connected components over equal keys, folded into ``bins`` balanced bins;
    whole bins go to splits by target share. Only the bins' weights (at most ``bins`` rows)
    reach the driver. A group larger than a split's share still stays whole.
    """
    groups = cut_lineage(related_groups(rows, id_col, keys))
    weights = groups.groupBy(F.col("group_key").alias("item")).agg(F.count(F.lit(1)).alias("weight"))
    placed = balanced_bins(weights, bins)
    heavy = placed.join(weights, "item").groupBy("bin").agg(F.sum("weight").alias("weight")).collect()  # at most `bins` rows
    split_of = allot([(r["bin"], r["weight"]) for r in heavy], targets)
    spark = rows.sparkSession
    chosen = spark.createDataFrame(list(split_of.items()), "bin bigint, split string")
    groups_split = placed.join(small(chosen), "bin").select(F.col("item").alias("group_key"), "split")
    return groups.join(groups_split, "group_key").select(id_col, "group_key", "split")


def _genomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genomes").select("genome_key", accession_key(F.col("accession")).alias("accession_key"), organism_key(F.col("lineage")).alias("organism_key"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of genomes that are linked to another one, with the smallest key of their group."""
    groups = cut_lineage(related_groups(_genomes(spark, d), "genome_key", ["accession_key", "organism_key"]))
    linked = groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_key")
    return groups.join(linked, "group_key", "left_semi").select("genome_key", "group_key")


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    """Every row of genomes with its group and split, 80/10/10."""
    return grouped_split(_genomes(spark, d), "genome_key", ["accession_key", "organism_key"])
