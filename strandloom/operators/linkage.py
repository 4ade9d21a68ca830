"""Trees from a table of distances by joins: many pairs merge per round, none of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut_lineage

KINDS = ("average", "neighbour")


def linkage_tree(distances: DataFrame, kind: str = "average") -> DataFrame:
    """``(node, parent, leaves, length, height)`` of the tree over ``distances(a, b, d)``, a < b, each pair once.

    A leaf is its name, an inner node ``(left,right)`` with its children in order, so equal trees have equal nodes; the root has a null parent.
    ``average`` is average linkage: pairs that are each other's nearest merge, all of them in one round, which gives the same tree as
    merging the nearest pair each time; ``height`` is half the distance of the children. ``neighbour`` is relaxed neighbour joining:
    pairs that are each other's best by (n - 2) d - r_a - r_b merge in one round, ``length`` is the branch to the parent
    (at least 0); on additive distances this is the neighbour-joining tree. Ties fall to the smaller pair of names. One
    pair of names at least is needed, or the result is empty. Each round is a few joins over the pairs that are left, cut from its lineage.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    conf, key = distances.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key)
    conf.set(key, "false")  # a checkpoint keeps what is known about its columns, which doubles with every round of renamed joins
    try:
        return _merge_rounds(distances, kind)
    finally:
        conf.set(key, before)


def _merge_rounds(distances: DataFrame, kind: str) -> DataFrame:
    """The rounds of ``linkage_tree``."""
    left = cut_lineage(distances.where("a < b and d is not null").select("a", "b", F.col("d").cast("double").alias("d")))
    both = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    nodes = cut_lineage(both(left).select(F.col("a").alias("node")).distinct().withColumn("n", F.lit(1)).withColumn("height", F.lit(0.0)))
    out = None
    while (count := nodes.count()) > 1:
        pairs = both(left)
        if kind == "neighbour" and count > 2:
            total = pairs.groupBy("a").agg(F.sum("d").alias("r"))
            of = lambda s: total.select(F.col("a").alias(s), F.col("r").alias(f"r{s}"))
            pairs = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("q", (count - 2) * F.col("d") - F.col("ra") - F.col("rb"))
            skew = (F.col("ra") - F.col("rb")) / (2 * (count - 2))
        else:
            pairs, skew = pairs.withColumn("q", F.col("d")), F.lit(0.0)
        # rounded, so that the order of a sum does not decide between equal pairs
        order = F.struct(F.round("q", 9).alias("q"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        best = pairs.withColumn("skew", skew).groupBy("a").agg(F.min(order).alias("o"), F.min_by(F.struct("b", "d", "skew"), order).alias("m"))
        best = best.select("a", F.col("m.b").alias("b"), F.col("m.d").alias("d"), F.col("m.skew").alias("skew"))
        mutual = best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])  # both directions
        title = F.concat(F.lit("("), F.least("a", "b"), F.lit(","), F.greatest("a", "b"), F.lit(")"))
        merged = cut_lineage(mutual.select(F.col("a").alias("node"), title.alias("parent"), "d", "skew"))
        if merged.isEmpty():
            raise ValueError("not every pair of names has a distance")
        done = nodes.join(merged, "node")
        length = F.greatest(F.col("d") / 2 + F.col("skew"), F.lit(0.0)) if kind == "neighbour" else F.col("d") / 2 - F.col("height")
        rows = cut_lineage(done.select("node", "parent", F.col("n").alias("leaves"), length.alias("length"), "height"))
        out = rows if out is None else out.unionByName(rows)
        names = nodes.join(merged.select("node", "parent", "d"), "node", "left").select("node", "n", F.coalesce("parent", "node").alias("now"), F.when(F.col("parent").isNotNull(), F.col("d")).alias("own"), "height")
        names = cut_lineage(names)
        nodes = cut_lineage(names.groupBy(F.col("now").alias("node")).agg(F.sum("n").cast("int").alias("n"), F.coalesce(F.max("own") / 2, F.max("height")).alias("height")))
        side = lambda s: names.select(F.col("node").alias(s), F.col("now").alias(f"{s}_now"), F.col("n").alias(f"{s}_n"), F.col("own").alias(f"{s}_own"))
        kept = left.join(side("a"), "a").join(side("b"), "b").where("a_now <> b_now")
        turn = F.col("a_now") < F.col("b_now")
        keys = [F.least("a_now", "b_now").alias("a"), F.greatest("a_now", "b_now").alias("b")]
        weight = F.col("a_n") * F.col("b_n") if kind == "average" else F.lit(1)
        sums = kept.withColumn("w", weight).groupBy(*keys).agg(F.sum(F.col("d") * F.col("w")).alias("s"), F.sum("w").alias("w"), F.max(F.when(turn, F.col("a_own")).otherwise(F.col("b_own"))).alias("oa"), F.max(F.when(turn, F.col("b_own")).otherwise(F.col("a_own"))).alias("ob"))
        mean = F.col("s") / F.col("w")
        if kind == "neighbour":
            mean = mean - F.coalesce(F.col("oa"), F.lit(0.0)) / 2 - F.coalesce(F.col("ob"), F.lit(0.0)) / 2
        left = cut_lineage(sums.select("a", "b", mean.alias("d")))
    if out is None:
        return distances.sparkSession.createDataFrame([], "node string, parent string, leaves int, length double, height double")
    return out.unionByName(nodes.select("node", F.lit(None).cast("string").alias("parent"), F.col("n").alias("leaves"), F.lit(None).cast("double").alias("length"), "height"))
