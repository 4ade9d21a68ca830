"""Read classification by node models, best hits and probability outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.operators.kmers import word_counts
from strandloom.session import cut_lineage, each_of, small


def present_counts(counts: DataFrame, markers: DataFrame, method: str = "max") -> DataFrame:
    """``(id, marker, cnt, length)`` for the markers that a read holds on some strand: both strands' counts combined.

    ``counts`` as of ``word_counts``; ``markers(marker, kmer)``, a checked broadcast.
    """
    from strandloom.functions.seq import reverse_complement

    wanted = markers.select("marker", "kmer").distinct()
    sides = wanted.select("marker", F.col("kmer"), F.lit(0).alias("s")).unionByName(wanted.select("marker", reverse_complement(F.col("kmer")).alias("kmer"), F.lit(1).alias("s")))
    found = counts.join(small(sides, 200_000), "kmer").groupBy("id", "marker").agg(F.first("length").alias("length"), F.sum(F.when(F.col("s") == 0, F.col("cnt")).otherwise(0)).alias("a"), F.sum(F.when(F.col("s") == 1, F.col("cnt")).otherwise(0)).alias("b"))
    combine = {"max": F.greatest("a", "b"), "min": F.least("a", "b"), "average": (F.col("a") + F.col("b")) / 2}
    if method not in combine:
        raise ValueError(f"unknown method {method}")
    return found.select("id", "marker", combine[method].alias("cnt"), "length")


def strand_counts(counts: DataFrame, markers: DataFrame, method: str = "max") -> DataFrame:
    """``present_counts`` for every read and marker; a marker that a read lacks has 0."""
    reads = counts.groupBy("id").agg(F.first("length").alias("length"))
    cells = each_of(reads, markers.select("marker").distinct(), "marker")
    found = present_counts(counts, markers, method).drop("length")
    return cells.join(found, ["id", "marker"], "left").select("id", "marker", F.coalesce("cnt", F.lit(0)).alias("cnt"), "length")


def read_values(cells: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Adds ``value`` (-2, -1, 1, 2); the word length is that of the marker's word."""
    word = F.split("marker", r"\|").getItem(0)
    value = None
    for k in ks:
        v = L.on_scale(L.level_of(k, F.col("cnt"), F.col("length")), L.VALUES)
        value = F.when(F.length(word) == k, v) if value is None else value.when(F.length(word) == k, v)
    return cells.withColumn("value", value)


def _match(mean: Column, value: Column) -> Column:
    """Whole agreement 0..4 of a mean and a value; the mean counts at nine decimals, so that it does not depend on the order of its sum."""
    return (4 - F.floor(F.round(F.abs(mean - value), 9))).cast("bigint")


def _changes(model: DataFrame) -> DataFrame:
    """``model`` with a row per ``value`` above level 0 and the ``change`` of agreement against an absent marker, where there is any."""
    each = model.withColumn("value", F.explode(F.array(*[F.lit(v) for v in L.VALUES[1:]])))
    change = _match(F.col("mean"), F.col("value")) - _match(F.col("mean"), F.lit(L.VALUES[0]))
    return each.withColumn("change", change).where("change <> 0").drop("mean")


def read_agreement(counts: DataFrame, model: DataFrame, markers: DataFrame, ks: tuple[int, ...], method: str = "max") -> DataFrame:
    """``agreement`` straight from word counts: ``(id, label, score)`` for every read and label.

    A read agrees with a label as one that lacks all its markers does, a sum per label, but for the markers that the read
    has above level 0: only these meet the model, in a join on the marker, and one aggregation sums what they change.
    """
    lacking = model.groupBy("label").agg(F.sum(_match(F.col("mean"), F.lit(L.VALUES[0]))).alias("base"), F.count(F.lit(1)).alias("n"))
    values = read_values(present_counts(counts, markers, method), ks).where(F.col("value") > L.VALUES[0])
    changed = values.join(small(cut_lineage(_changes(model)), 200_000), ["marker", "value"]).groupBy("id", "label").agg(F.sum("change").alias("change"))
    each = each_of(counts.select("id").distinct(), lacking.select(F.struct("label", "base", "n").alias("_l")), "_l").select("id", "_l.label", "_l.base", "_l.n")
    score = (F.col("base") + F.coalesce("change", F.lit(0))) / (4.0 * F.col("n"))
    return each.join(changed, ["id", "label"], "left").select("id", "label", score.alias("score"))


def agreement(values: DataFrame, model: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(id, keys, label, score)``: mean of 4 - floor(|mean - value|) over the markers, / 4.

    ``model(keys, marker, label, mean)`` is broadcast if it is as small as a node model should be.
    """
    match = 4 - F.floor(F.abs(F.col("mean") - F.col("value")))
    joined = values.join(small(model, 200_000), ["marker", *[k for k in keys if k in values.columns]])
    return joined.groupBy("id", *keys, "label").agg((F.sum(match) / (4.0 * F.count(F.lit(1)))).alias("score"))


def product_score(values: DataFrame, model: DataFrame) -> DataFrame:
    """``(id, label, score)``: mean product of model mean and value, moved by (v + 2) / 4; not confined to 0..1."""
    joined = values.join(small(model, 200_000), "marker")
    return joined.groupBy("id", "label").agg(((F.avg(F.col("mean") * F.col("value")) + 2) / 4).alias("score"))


def descend(values: DataFrame, model: DataFrame, edges: DataFrame, accuracy: float = 0.5, specificity: float = 0.7, reads: DataFrame | None = None) -> DataFrame:
    """``(id, taxon, identity, path, species_level)``: hits of reads on their way down a tree of node models.

    ``model(node, marker, label, mean)``, ``edges(node, label, child)`` with a null child at the end. From each node a read goes to
    every label of at least ``accuracy``; labels of at least ``specificity`` are hits. A read that nothing at a
    node accepts leaves an unresolved hit of that node. All reads move one level per round; the frontier is cut from its lineage.
    ``values(id, marker, value)`` need rows only for the markers of a read above level 0, the others are -2; ``reads(id)`` names the
    reads if some may have no such marker. The rounds end when no read is left to move; a tree has no cycle, so more rounds than edges are an error.
    """
    rounds = edges.count()
    lacking = F.lit(L.VALUES[0])
    base = cut_lineage(model.groupBy("node", "label").agg(F.sum(_match(F.col("mean"), lacking)).alias("base"), F.count(F.lit(1)).alias("n")))
    present = values.where(F.col("value") > L.VALUES[0])
    start = (values if reads is None else reads).select("id").distinct()
    frontier = cut_lineage(start.select("id", F.lit("root").alias("node"), F.lit("Root").alias("path"), F.lit(0.0).alias("before")))
    hits = None
    for _ in range(rounds + 1):
        change = F.sum(_match(F.col("mean"), F.col("value")) - _match(F.col("mean"), lacking))
        changed = frontier.select("id", "node").distinct().join(present, "id").join(small(model, 200_000), ["node", "marker"]).groupBy("id", "node", "label").agg(change.alias("change"))
        each = frontier.join(small(base), "node").join(changed, ["id", "node", "label"], "left")
        score = each.select("id", "node", "path", "before", "label", ((F.col("base") + F.coalesce("change", F.lit(0))) / (4.0 * F.col("n"))).alias("score"))
        score = cut_lineage(score.join(small(edges), ["node", "label"], "left"))
        found = score.where(F.col("score") >= specificity).select("id", F.col("label").alias("taxon"), F.col("score").alias("identity"), "path", F.col("child").isNull().alias("species_level"))
        lost = score.groupBy("id", "node", "path", "before").agg(F.max("score").alias("m"), F.bool_or(F.col("child").isNotNull()).alias("inner")).where((F.col("m") < accuracy) & F.col("inner"))
        found = found.unionByName(lost.select("id", F.col("node").alias("taxon"), F.col("before").alias("identity"), "path", F.lit(False).alias("species_level")))
        hits = found if hits is None else hits.unionByName(found)
        frontier = cut_lineage(score.where((F.col("score") >= accuracy) & F.col("child").isNotNull()).select("id", F.col("child").alias("node"), F.concat_ws(".", "path", "label").alias("path"), F.col("score").alias("before")))
        if frontier.isEmpty():
            return hits
    raise ValueError("the edges have a cycle")


def best_hits(hits: DataFrame, read: str, identity: str, path: str, final: str, taxon: str) -> DataFrame:
    """All final hits of a read by identity; if it has none, its deepest and then best other hit. Adds ``place``."""
    depth = F.size(F.split(path, r"[.>]"))
    is_final = F.coalesce(F.col(final), F.lit(False))
    order = W.partitionBy(read).orderBy(is_final.desc(), F.when(is_final, F.lit(0)).otherwise(-depth), F.col(identity).desc_nulls_last(), F.col(taxon).asc_nulls_last(), F.col(path).asc_nulls_last())
    return hits.withColumn("place", F.row_number().over(order)).where(is_final | (F.col("place") == 1))


def probability_report(scores: DataFrame, read: str, p: str) -> DataFrame:
    """Per row the odds below the best ones, and per read the normalised entropy.

    Odds are p / (1 - p), 10 at p = 1; entropy is 0 if any p is 0 or 1 or there is one class only.
    """
    odds = F.when(F.col(p) >= 1, F.lit(10.0)).otherwise(F.col(p) / (1 - F.col(p)))
    part = W.partitionBy(read)
    n = F.count(F.lit(1)).over(part)
    sharp = F.max(((F.col(p) <= 0) | (F.col(p) >= 1)).cast("int")).over(part)
    h = F.sum(F.when((F.col(p) > 0) & (F.col(p) < 1), -F.col(p) * F.log2(F.col(p))).otherwise(0.0)).over(part)
    out = scores.withColumn("_o", odds)
    top = F.max("_o").over(part)
    return out.withColumn("odds_gap", F.when(F.col("_o") == top, F.lit(1.0)).otherwise(top - F.col("_o"))).withColumn("entropy", F.when((n < 2) | (sharp == 1), F.lit(0.0)).otherwise(h / F.log2(n))).drop("_o")


def read_marker_values(reads: DataFrame, id_col: str, seq_col: str, markers: DataFrame, ks: tuple[int, ...], shortest: int = 0, longest: int = 0, method: str = "max") -> DataFrame:
    """Values of all markers for reads within the length bounds (0: no upper bound)."""
    n = F.length(F.regexp_replace(seq_col, r"\s+", ""))
    fit = reads.where((n >= shortest) & ((F.lit(longest) == 0) | (n <= longest)))
    return read_values(strand_counts(word_counts(fit, id_col, seq_col, ks), markers, method), ks)


def normalised_value(value: Column) -> Column:
    """Clipped to [-2, 2]; null, NaN and infinite as 0."""
    v = value.cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), v))).otherwise(F.lit(0.0))


def gated(rules: DataFrame, learnt: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """``(id, label, score, learnt)``: a read's calls by its node's model where one exists and is sure, else by the rules.

    ``learnt(id, label, p, entropy)`` are class probabilities of reads whose node has a model; a read is sure if its entropy is at most ``cutoff``.
    ``rules(id, label, score)`` are the scores of the decision table. A null entropy is not sure; reads without any row have none.
    """
    sure = learnt.where(F.col("entropy") <= cutoff)
    kept = rules.join(sure.select("id").distinct(), "id", "left_anti")
    return kept.select("id", "label", "score", F.lit(False).alias("learnt")).unionByName(sure.select("id", "label", F.col("p").alias("score"), F.lit(True).alias("learnt")))
