"""Feature tables in long form and the choice of marker words.

A feature table is ``(node, name, taxon, marker, value)``: value -2, -1, 1 or 2 of a marker for one
genome (name) of a taxon below a node. Wide matrices appear only at CSV and ML borders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandloom.functions import levels as L
from strandloom.session import each_of, small


def marker_title(kmer: Column, k: Column, x: Column, y: Column) -> Column:
    """``KMER|k|x|y``."""
    return F.concat_ws("|", kmer, k.cast("string"), x.cast("string"), y.cast("string"))


def dense_features(genomes: DataFrame, markers: DataFrame, levels: DataFrame, default: int = -2) -> DataFrame:
    """Value of every marker for every genome; ``default`` where a genome lacks it.

    ``genomes(name, ...)``, ``markers(marker)``, ``levels(name, marker, level)``. The product of genomes and a marker
    list is the definition of a matrix; the markers (at most 4^k words) are the side that is checked and broadcast.
    """
    cells = each_of(genomes, markers.select("marker").distinct(), "marker")
    known = levels.select("name", "marker", L.on_scale(F.col("level"), L.VALUES).alias("value"))
    return cells.join(known, ["name", "marker"], "left").withColumn("value", F.coalesce("value", F.lit(default)))


def marker_means(features: DataFrame, *keys: str) -> DataFrame:
    """Mean value per marker (per ``keys``), nulls left out."""
    return features.groupBy(*keys, "marker").agg(F.avg("value").alias("mean"))


def select_by_mean(means: DataFrame, keys: tuple[str, ...] = (), diverse: tuple[float, float] = (-0.5, 0.5), common: tuple[float, float] = (-1.0, 1.0), least: int = 0) -> DataFrame:
    """``means`` with ``is_diverse`` and ``is_common``.

    Diverse means lie in [lo, hi], common ones at most lo' or at least hi'. Where fewer than ``least`` markers
    of a kind exist, the kind is instead the ``least`` markers of smallest (largest) absolute mean,
    ties to the smaller marker; null means never count.
    """
    if diverse[0] > diverse[1] or common[0] >= common[1]:
        raise ValueError("bounds are not in order")
    part = W.partitionBy(*keys)
    size = F.abs("mean")
    m = means.where("mean is not null").withColumn("_d", F.col("mean").between(*diverse)).withColumn("_c", (F.col("mean") <= common[0]) | (F.col("mean") >= common[1]))
    m = m.withColumn("_nd", F.count_if("_d").over(part)).withColumn("_nc", F.count_if("_c").over(part))
    m = m.withColumn("_rd", F.row_number().over(part.orderBy(size, "marker"))).withColumn("_rc", F.row_number().over(part.orderBy(F.desc(size), "marker")))
    by_rank = lambda n, r, flag: F.when(F.col(n) < least, F.col(r) <= least).otherwise(F.col(flag))
    return m.select(*keys, "marker", "mean", by_rank("_nd", "_rd", "_d").alias("is_diverse"), by_rank("_nc", "_rc", "_c").alias("is_common"))


def variance_scores(features: DataFrame, *keys: str, common: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """Sample variance of every marker's values as ``score``, negated where the mean lies in the common range.

    Null values are left out; a marker with fewer than two values has a null score.
    """
    s = features.groupBy(*keys, "marker").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("_v"))
    usual = (F.col("mean") <= common[0]) | (F.col("mean") >= common[1])
    return s.select(*keys, "marker", "mean", F.when(usual, -F.col("_v")).otherwise(F.col("_v")).alias("score"))


def clean_features(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Classifier input: labels trimmed, rows with a null, blank or NaN label dropped, values as integers, unreadable ones 0."""
    named = rows.withColumn(label, F.trim(label)).where((F.col(label) != "") & ~F.lower(label).isin("nan", "none", "null"))
    return named.withColumn(value, F.coalesce(F.trim(F.col(value).cast("string")).try_cast("int"), F.lit(0)))


def chi_square(features: DataFrame, label: str = "taxon", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, marker, chi2, dof, n)`` of the contingency of label and value.

    N (sum o^2 / (row * column) - 1), so empty cells cost nothing; at one degree of freedom the continuity
    correction is applied. chi2 is null for tables smaller than 2 x 2. One aggregation; margins are windows over its counts.
    """
    cells = features.where(F.col(label).isNotNull() & F.col("value").isNotNull()).groupBy(*keys, "marker", label, "value").agg(F.count(F.lit(1)).alias("o"))
    by = [*keys, "marker"]
    cells = cells.withColumn("r", F.sum("o").over(W.partitionBy(*by, label))).withColumn("c", F.sum("o").over(W.partitionBy(*by, "value")))
    o, r, c = (F.col(x).cast("double") for x in "orc")
    sums = cells.groupBy(*by).agg(
        F.sum("o").alias("n"),
        F.size(F.collect_set(label)).alias("rows"),
        F.size(F.collect_set("value")).alias("cols"),
        F.sum(o * o / (r * c)).alias("q"),
        F.min("r").alias("r0"),
        F.min("c").alias("c0"),
        F.min_by("o", F.struct("r", "c", label, "value")).alias("o0"),
        F.min_by("c", F.struct("r", "c", label, "value")).alias("oc"),
        F.min_by("r", F.struct("r", "c", label, "value")).alias("orr"),
    )
    plain = F.col("n") * (F.col("q") - 1)
    # all four cells of a 2 x 2 table miss their expectation by the same amount, half of which the correction takes
    e = F.col("orr").cast("double") * F.col("oc") / F.col("n")
    off = F.abs(F.col("o0") - e)
    less = F.greatest(off - F.least(F.lit(0.5), off), F.lit(0.0))
    corrected = F.when(off > 0, plain * less * less / (off * off)).otherwise(F.lit(0.0))
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    chi = F.when(dof == 0, F.lit(None)).when(dof == 1, corrected).otherwise(F.greatest(plain, F.lit(0.0)))
    return sums.select(*keys, "marker", chi.cast("double").alias("chi2"), dof.cast("bigint").alias("dof"), F.col("n"))


def chi_square_tail(x: float, dof: int) -> float:
    """Probability of more than ``x`` under chi-square with ``dof`` degrees, by the finite sums for whole degrees."""
    if dof % 2 == 0:
        term = total = 1.0
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, math.exp(-x / 2) * total) if x < 1400 else 0.0
    total, term = 0.0, 1.0
    for j in range(1, dof - 1, 2):
        term = 1.0 if j == 1 else term * x / j
        total += term
    return min(1.0, math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total)


@F.pandas_udf(DoubleType())
def _tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, dof in batches:
        yield pd.Series([None if pd.isna(a) or b < 1 else chi_square_tail(float(a), int(b)) for a, b in zip(x, dof, strict=True)], dtype="float64")


def with_p_values(chi: DataFrame) -> DataFrame:
    """Adds ``p``; one row per marker, so Python sees a few thousand numbers."""
    return chi.withColumn("p", _tail("chi2", "dof"))


def with_fdr(tests: DataFrame, keys: tuple[str, ...] = (), alpha: float = 0.05) -> DataFrame:
    """Adds Benjamini-Hochberg ``fdr`` over the valid p-values and ``significant`` (fdr < alpha)."""
    part = W.partitionBy(F.col("p").isNotNull(), *keys)
    m = F.count("p").over(part)
    rank = F.row_number().over(part.orderBy("p", "marker"))
    raw = tests.withColumn("_q", F.when(F.col("p").isNotNull(), F.col("p") * m / rank)).withColumn("_r", rank)
    fdr = F.least(F.lit(1.0), F.min("_q").over(part.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)))
    out = raw.withColumn("fdr", F.when(F.col("p").isNotNull(), fdr))
    return out.withColumn("significant", F.coalesce(F.col("fdr") < alpha, F.lit(False))).drop("_q", "_r")


def rank_markers(tests: DataFrame, keys: tuple[str, ...] = (), long_words_first: bool = False) -> DataFrame:
    """Adds ``rank``: fdr, p, word length (malformed titles last), title; null statistics last."""
    k = F.coalesce(F.get(F.split("marker", r"\|"), F.lit(1)).try_cast("bigint"), F.lit(10**9))
    title = F.desc("marker") if long_words_first else F.asc("marker")
    order = W.partitionBy(*keys).orderBy(F.col("fdr").asc_nulls_last(), F.col("p").asc_nulls_last(), k, title)
    return tests.withColumn("rank", F.row_number().over(order))


def select_ranked(ranked: DataFrame, keys: tuple[str, ...] = (), p_value: float | None = 0.05, significant: bool = True, least: int = 10, most: int | None = 100) -> DataFrame:
    """Markers that pass the filters, topped up by rank to ``least`` and cut by rank to max(most, least)."""
    ok = F.lit(True)
    if p_value is not None:
        ok = ok & F.coalesce(F.col("p") <= p_value, F.lit(False))
    if significant:
        ok = ok & F.col("significant")
    part = W.partitionBy(*keys)
    r = ranked.withColumn("_ok", ok).withColumn("_n", F.count_if("_ok").over(part))
    r = r.withColumn("_rest", F.row_number().over(W.partitionBy(*keys, "_ok").orderBy("rank")))
    r = r.where(F.col("_ok") | (F.col("_rest") <= F.lit(least) - F.col("_n")))
    if most:
        r = r.withColumn("_at", F.row_number().over(part.orderBy("rank"))).where(F.col("_at") <= max(most, least)).drop("_at")
    return r.drop("_ok", "_n", "_rest")


def group_means(features: DataFrame, label: str = "taxon", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, marker, label, mean)``: the cells of a node model."""
    return features.where(F.col(label).isNotNull()).groupBy(*keys, "marker", label).agg(F.avg("value").alias("mean"))


def median_cluster(labels: DataFrame, label: str = "taxon", keys: tuple[str, ...] = ()) -> DataFrame:
    """Whole part of the median number of genomes per label; ``labels(name, label)``, each genome once."""
    sizes = labels.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.countDistinct("name").alias("n"))
    return sizes.groupBy(*keys).agg(F.floor(F.percentile("n", 0.5)).cast("int").alias("median_size"), F.count(F.lit(1)).alias("labels"))


def shared_markers(features: DataFrame, child: str = "taxon", keys: tuple[str, ...] = ()) -> DataFrame:
    """Markers present in every child of a node (the intersection of columns)."""
    total = features.groupBy(*keys).agg(F.countDistinct(child).alias("_t"))
    each = features.groupBy(*keys, "marker").agg(F.countDistinct(child).alias("children"))
    whole = each.join(small(total), list(keys)) if keys else each.crossJoin(F.broadcast(total))  # without keys a single row
    return whole.where("children = _t").drop("_t")


def padding_markers(features: DataFrame, need: int, child: str = "taxon") -> DataFrame:
    """The ``need`` markers of most children among those that some child lacks; ties to the smaller marker."""
    each = features.groupBy("marker").agg(F.countDistinct(child).alias("children"))
    total = features.agg(F.countDistinct(child).alias("_t"))
    lacking = each.crossJoin(F.broadcast(total)).where("children < _t").drop("_t")  # one-row side
    return lacking.orderBy(F.desc("children"), "marker").limit(need)


def summarize_children(features: DataFrame, parents: DataFrame, top: int = 100) -> DataFrame:
    """Features of the parents of a tree level: all children's rows, relabelled by child, over the shared markers.

    ``features(node, name, taxon, marker, value)``, ``parents(node, parent, title)``. Where children share fewer than 3 * top
    markers, the most frequent others pad the table, missing cells with 0. All nodes of a level are one job.
    """
    lifted = features.join(small(parents), "node").select(F.col("parent").alias("node"), "name", F.col("title").alias("taxon"), "marker", "value")
    total = lifted.groupBy("node").agg(F.countDistinct("taxon").alias("_t"))
    each = lifted.groupBy("node", "marker").agg(F.countDistinct("taxon").alias("_c")).join(small(total), "node")
    whole = F.count_if(F.col("_c") == F.col("_t")).over(W.partitionBy("node"))
    order = W.partitionBy("node", F.col("_c") == F.col("_t")).orderBy(F.desc("_c"), "marker")
    kept = each.withColumn("_w", whole).withColumn("_r", F.row_number().over(order))
    kept = kept.where((F.col("_c") == F.col("_t")) | (F.col("_r") <= 3 * top - F.col("_w"))).select("node", "marker")
    rows = lifted.select("node", "name", "taxon").distinct()
    cells = rows.join(kept, "node")
    return cells.join(lifted, ["node", "name", "taxon", "marker"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def merge_leaf(features: DataFrame, diverse: tuple[float, float] = (-0.5, 0.5), least: int = 10, absent: int = -2) -> DataFrame:
    """``(node, k, marker, mean)``: the diverse markers of every leaf node, chosen for each word length on its own and put together.

    ``features(node, name, k, marker, value)`` needs rows for the words that a genome has; the missing ones count as ``absent``, so
    the matrix is never laid out. Nodes and word lengths are one job.
    """
    genomes = features.groupBy("node", "k").agg(F.countDistinct("name").alias("_g"))
    sums = features.groupBy("node", "k", "marker").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    mean = (F.col("_s") + absent * (F.col("_g") - F.col("_n"))).cast("double") / F.col("_g")
    means = sums.join(genomes, ["node", "k"]).select("node", "k", "marker", mean.alias("mean"))
    return select_by_mean(means, ("node", "k"), diverse=diverse, least=least).where("is_diverse").select("node", "k", "marker", "mean")


def missing_rows(rows: DataFrame, part: str, titles: list[str]) -> DataFrame:
    """``(part, titles)`` that another part of a table has and this one lacks: no row means that the parts join row by row.

    ``rows(part, titles)`` with each row once. All titles are expected in all parts; the parts (word lengths, files) are checked to be few.
    """
    every = each_of(rows.select(*titles).distinct(), rows.select(part).distinct(), part)
    return every.select(part, *titles).join(rows.select(part, *titles), [part, *titles], "left_anti")


def join_columns(a: DataFrame, b: DataFrame, titles: list[str]) -> DataFrame:
    """Two wide matrices side by side; ValueError if their title columns do not hold the same rows."""
    off = a.select(*titles).exceptAll(b.select(*titles)).unionByName(b.select(*titles).exceptAll(a.select(*titles)))
    if not off.isEmpty():
        raise ValueError(f"the matrices differ in their rows by {titles}")
    return a.join(b, titles)
