"""Trees as tables: every prefix of a lineage is a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lineage_parts(lineage: Column) -> Column:
    """Trimmed, non-empty elements of a ``a|b|c`` lineage."""
    return F.filter(F.transform(F.split(lineage, r"\|"), lambda e: F.trim(e)), lambda e: e != "")


def tree_nodes(leaves: DataFrame, parts: str = "parts") -> DataFrame:
    """``(path, parent, title, depth, leaves, is_end)`` from leaf paths (arrays); parent of a top node is null."""
    steps = leaves.where(F.size(parts) > 0).select(parts, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    path = F.array_join(F.slice(parts, F.lit(1), F.col("depth")), ">")
    parent = F.when(F.col("depth") > 1, F.array_join(F.slice(parts, F.lit(1), F.col("depth") - 1), ">"))
    nodes = steps.select(path.alias("path"), parent.alias("parent"), F.element_at(parts, F.col("depth")).alias("title"), "depth", (F.col("depth") == F.size(parts)).alias("end"))
    return nodes.groupBy("path").agg(F.first("parent").alias("parent"), F.first("title").alias("title"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("leaves"), F.bool_or("end").alias("is_end"))


def children_counts(nodes: DataFrame) -> DataFrame:
    """Children and subordinate leaves of each node that has children."""
    return nodes.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"))


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are no other node's parent."""
    parents = nodes.select(F.col("parent").alias("path")).where("path is not null").distinct()
    return nodes.join(parents, "path", "left_anti")


def group_ancestor(leaves: DataFrame, group: str, parts: str = "parts") -> DataFrame:
    """``(group, lca_depth, members, monophyletic)``: the deepest node over all members of a group.

    A group is monophyletic if nobody else lies below that node. Counts per prefix decide, in two aggregations.
    """
    rows = leaves.where(F.size(parts) > 0)
    steps = rows.select(group, parts, F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    steps = steps.select(group, "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), ">").alias("path"))
    total = steps.groupBy("path", "depth").agg(F.count(F.lit(1)).alias("all"))
    own = steps.where(F.col(group).isNotNull()).groupBy(group, "path", "depth").agg(F.count(F.lit(1)).alias("members"))
    whole = own.withColumn("_n", F.max("members").over(W.partitionBy(group))).where("members = _n")
    deepest = whole.groupBy(group).agg(F.max("depth").alias("lca_depth"), F.first("_n").alias("members"), F.max_by("path", "depth").alias("path"))
    return deepest.join(total.select("path", "all"), "path").select(group, "lca_depth", "members", (F.col("all") == F.col("members")).alias("monophyletic"))


def branch_metrics(nodes: DataFrame, length: str | None = None) -> DataFrame:
    """``(path, ends, longest, shortest, average, total)``: distances from each inner node to the end nodes below it.

    ``length`` is the column of branch lengths (1 each if None). A node's distance to the root is a sum over its
    prefixes, so all distances come from one join of prefixes and one aggregation.
    """
    own = F.col(length).cast("double") if length else F.lit(1.0)
    base = nodes.select("path", "depth", "is_end", own.alias("_own"))
    prefix = F.explode(F.sequence(F.lit(1), F.col("depth")))
    steps = base.select("path", "depth", F.split("path", ">").alias("_p"), prefix.alias("_i")).select("path", "_i", F.array_join(F.slice("_p", F.lit(1), F.col("_i")), ">").alias("up"))
    lengths = base.select(F.col("path").alias("up"), "_own")
    at = steps.join(lengths, "up").groupBy("path").agg(F.sum("_own").alias("_root"))
    ends = base.where("is_end").select("path").join(at, "path").withColumnRenamed("_root", "_end")
    below = steps.where("up <> path").join(ends, "path").join(at.select(F.col("path").alias("up"), "_root"), "up")
    gap = F.col("_end") - F.col("_root")
    return below.groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("ends"), F.max(gap).alias("longest"), F.min(gap).alias("shortest"), F.avg(gap).alias("average"), F.sum(gap).alias("total"))


def depth_cuts(nodes: DataFrame, sectors: int = 4) -> DataFrame:
    """``(sector, path, leaves)``: the maximal subtrees below each of ``sectors`` - 1 equal-count depths.

    The depths are exact quantiles of the nodes' depths; a subtree's root lies at or below the depth and its parent above.
    """
    edges = nodes.agg(F.percentile("depth", F.array(*[F.lit(i / sectors) for i in range(1, sectors)])).alias("e"))
    cut = edges.select(F.posexplode("e").alias("sector", "edge"))  # a row per sector
    return F.broadcast(cut).join(nodes, (F.col("depth") >= F.col("edge")) & (F.col("depth") - 1 < F.col("edge"))).select((F.col("sector") + 1).alias("sector"), "path", "leaves")


def bottom_up(nodes: DataFrame, diverse: tuple[float, float] = (-0.5, 0.5), common: tuple[float, float] = (-1.0, 1.0), increment: float = 0.1) -> DataFrame:
    """Nodes in the order of a summary, deepest first, with the thresholds of their level: ``increment`` wider per level up.

    ``place`` comes from a distributed rank. No nodes give no rows.
    """
    from strandloom.operators.ranking import global_rank

    deepest = nodes.agg(F.max("depth").alias("_d"))
    up = F.col("_d") - F.col("depth")
    rows = nodes.crossJoin(F.broadcast(deepest)).select(  # one-row side
        "path",
        "depth",
        (F.lit(diverse[0]) - increment * up).alias("diverse_low"),
        (F.lit(diverse[1]) + increment * up).alias("diverse_high"),
        (F.lit(common[0]) - increment * up).alias("common_low"),
        (F.lit(common[1]) + increment * up).alias("common_high"),
    )
    return global_rank(rows, [F.desc("depth"), F.col("path")], "place")


def path_distance(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``shared_depth``, ``distance`` (steps over the deepest common node) and ``relative`` (of the sum of both depths) of two paths (arrays)."""
    at = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
    shared = F.array_max(F.filter(at, lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    both = F.size(a) + F.size(b)
    steps = both - 2 * F.col("shared_depth")
    return rows.withColumn("shared_depth", shared).withColumn("distance", steps).withColumn("relative", F.when(both > 0, steps / both).otherwise(F.lit(0.0)))


def admixture(leaves: DataFrame, group: str, parts: str = "parts") -> DataFrame:
    """``(group, members, others, admixture)``: leaves of other groups below the deepest common node of a group, and their share of all leaves there."""
    rows = leaves.where(F.size(parts) > 0)
    steps = rows.select(group, F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), ">").alias("path")))).alias("s"))
    steps = steps.select(group, "s.depth", "s.path")
    total = steps.groupBy("path", "depth").agg(F.count(F.lit(1)).alias("_all"))
    own = steps.where(F.col(group).isNotNull()).groupBy(group, "path", "depth").agg(F.count(F.lit(1)).alias("members"))
    whole = own.withColumn("_n", F.max("members").over(W.partitionBy(group))).where("members = _n")
    deepest = whole.groupBy(group).agg(F.max(F.struct("depth", "path", "members")).alias("d")).select(group, "d.depth", "d.path", "d.members")
    others = F.col("_all") - F.col("members")
    return deepest.join(total, ["path", "depth"]).select(group, "members", others.alias("others"), (others / F.col("_all")).alias("admixture"))


def overlap(leaves: DataFrame, group: str, parts: str = "parts") -> DataFrame:
    """``(a, b, nodes)``: tree nodes below which two groups, a < b, both have leaves.

    Groups meet by an equi-join on the node; each has a row per node only, however many leaves it has there.
    """
    rows = leaves.where(F.col(group).isNotNull() & (F.size(parts) > 0))
    steps = rows.select(group, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ">"))).alias("path")).distinct()
    both = steps.withColumnRenamed(group, "a").join(steps.withColumnRenamed(group, "b"), "path").where("a < b")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("nodes"))
