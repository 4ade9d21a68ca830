"""Word databases in long form: one row per accession and word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.functions.names import accession_form
from strandloom.functions.seq import word_at
from strandloom.operators.ranking import global_rank


def clean_words(rows: DataFrame) -> DataFrame:
    """``(acc, k, x, y, kmer, cnt, level)``: the newest row of every accession and word.

    Accessions are compared in their common form, lost words are restored from their coordinates, lost
    leading zeros of a level code do not matter; a null code gives a null level. Rows without an
    accession or coordinates are left out.
    """
    acc = accession_form(F.col("accession"))
    newest = W.partitionBy("acc", "k", "x", "y").orderBy(F.col("counted_at").desc_nulls_last(), F.col("word_id").desc())
    known = rows.select(acc.alias("acc"), "k", "x", "y", "kmer", "cnt", "level_code", "counted_at", "word_id").where("acc is not null and k is not null and x is not null and y is not null")
    one = known.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    word = F.coalesce(F.upper("kmer"), word_at(F.col("k"), F.col("x"), F.col("y")))
    return one.select("acc", "k", "x", "y", word.alias("kmer"), "cnt", L.level_of_code(F.col("level_code")).cast("int").alias("level"))


def geometry(words: DataFrame, kind: str) -> DataFrame:
    """Words kept by a matrix geometry: whole, lower (x <= y) or upper (x >= y)."""
    rule = {"whole": F.lit(True), "lower": F.col("x") <= F.col("y"), "upper": F.col("x") >= F.col("y")}
    return words.where(rule[kind])


def genome_ids(words: DataFrame) -> DataFrame:
    """Registry ``(acc, genome_id)``: ids from 1 in the order of accessions; one row per genome."""
    return global_rank(words.select("acc").distinct(), [F.col("acc")], "genome_id")


def replace_genome(words: DataFrame, new: DataFrame) -> DataFrame:
    """``words`` with all rows of the accessions in ``new`` replaced by those of ``new``."""
    return words.join(new.select("acc").distinct(), "acc", "left_anti").unionByName(new)


def db_info(words: DataFrame) -> DataFrame:
    """Genomes, words and entries per word length and (k null) over all."""
    return words.rollup("k").agg(F.countDistinct("acc").alias("genomes"), F.countDistinct("kmer").alias("words"), F.count(F.lit(1)).alias("entries"))


def level_counts(words: DataFrame, *keys: str) -> DataFrame:
    """Entries at each level (--, +, ++, +++) per key."""
    return words.groupBy(*keys).agg(*[F.count_if(F.col("level") == i).alias(f"n{i}") for i in range(4)])


def rank_statistics(words: DataFrame, *keys: str) -> DataFrame:
    """Mean and population variance on the rank scale, and of the rank borders less one."""
    rank, border = L.on_scale(F.col("level"), L.RANKS), L.on_scale(F.col("level"), L.BORDERS)
    return (
        words.where("level is not null")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(rank).alias("rank_mean"), F.var_pop(rank).alias("rank_var"), (F.avg(border) - 1).alias("border_mean"), F.var_pop(border).alias("border_var"))
    )


def divergency(words: DataFrame, *keys: str) -> DataFrame:
    """Divergency, commonality and rareness on 0..10 per key.

    Divergency is ten times the variance of the levels (as 0, .25, .75, 1) over that of the most
    divided sample of the same size (half 0, half 1); 0 for fewer than two entries. Commonality is
    ten times their mean, rareness its complement. Sums are whole numbers of quarters and each result is one
    division, so it does not depend on the order of the rows.
    """
    quarters = L.on_scale(F.col("level"), tuple(int(4 * v) for v in L.SAMPLE)).cast("bigint")
    agg = words.where("level is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(quarters).alias("_s"), F.sum(quarters * quarters).alias("_q"))
    half = F.floor(F.col("n") / 2)
    spread = 10 * (F.col("n") * F.col("_q") - F.col("_s") * F.col("_s"))
    return agg.select(
        *keys,
        "n",
        F.when(F.col("n") < 2, F.lit(0.0)).otherwise(spread / (16 * half * (F.col("n") - half))).alias("divergency"),
        (10 * F.col("_s") / (4 * F.col("n"))).alias("commonality"),
        ((40 * F.col("n") - 10 * F.col("_s")) / (4 * F.col("n"))).alias("rareness"),
    )


def confrontation(words: DataFrame, group_col: str, outgroup: str, mode: str = "+/-") -> DataFrame:
    """Score per word of an outgroup against all other groups: ``+/-`` difference, ``+++`` richer, else poorer.

    Borders are averaged per counterpart group first, then over groups; the outgroup's variance gives
    the standard error sqrt(1 + var / n). Words missing on either side have no row.
    """
    border = L.on_scale(F.col("level"), L.BORDERS)
    known = words.where(f"level is not null and {group_col} is not null")
    out = known.where(F.col(group_col) == outgroup).groupBy("k", "kmer").agg(F.avg(border).alias("o"), F.when(F.count(F.lit(1)) > 1, F.var_pop(border)).otherwise(0.0).alias("v"), F.count(F.lit(1)).alias("n"))
    per = known.where(F.col(group_col) != outgroup).groupBy("k", "kmer", group_col).agg(F.avg(border).alias("g"))
    other = per.groupBy("k", "kmer").agg(F.avg("g").alias("c"))
    error = F.sqrt(1 + F.col("v") / F.col("n"))
    score = {"+/-": F.abs(F.col("o") - F.col("c")) / error, "+++": (10 + F.col("o") - F.col("c")) / 2 / error}.get(mode, (10 + F.col("c") - F.col("o")) / 2 / error)
    return out.join(other, ["k", "kmer"]).select("k", "kmer", score.alias("score"))


def taxa_variance(words: DataFrame, group_col: str) -> DataFrame:
    """One-way F ratio of levels between groups per word, scaled so that the largest is 10.

    Sums of squares come from one aggregation per word and group. Words with fewer than two
    groups, no spare entries or no variance within have no row.
    """
    value = L.on_scale(F.col("level"), L.SAMPLE)
    per = words.where(f"level is not null and {group_col} is not null").groupBy("k", "kmer", group_col).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    word = per.groupBy("k", "kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("g") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("g"))
    kept = word.where("g > 1 and n > g").withColumn("_w", within).where("_w > 1e-12").withColumn("f", between / F.col("_w"))
    top = kept.agg(F.max("f").alias("top"))
    return kept.crossJoin(F.broadcast(top)).select("k", "kmer", (10 * F.col("f") / F.col("top")).alias("score"))  # one-row side


def extreme_words(scores: DataFrame, score: str, n: int) -> DataFrame:
    """The ``n`` words of highest score per word length, ties to the alphabetically first."""
    order = W.partitionBy("k").orderBy(F.desc(score), "kmer")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def without_dominated(scores: DataFrame, score: str) -> DataFrame:
    """Words that no neighbour (reverse complement, one substitution or a shift by one) outdoes; equal scores keep the alphabetically first."""
    from strandloom.functions.seq import reverse_complement, shifts, substitutions

    near = F.array_distinct(F.concat(F.array(reverse_complement(F.col("kmer"))), substitutions(F.col("kmer")), shifts(F.col("kmer")), shifts(F.col("kmer"), left=True)))
    pairs = scores.select("kmer", F.col(score).alias("_s"), F.explode(near).alias("other")).where("other <> kmer")
    rival = scores.select(F.col("kmer").alias("other"), F.col(score).alias("_r"))
    beaten = pairs.join(rival, "other").where("_r > _s or (_r = _s and other < kmer)").select("kmer").distinct()
    return scores.join(beaten, "kmer", "left_anti")


def lookup(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every word of ``wanted(kmer)`` with its genomes and counts on both strands: ``(kmer, acc, cnt, rc_cnt)``.

    A genome has a row if it holds the word or its reverse complement; the missing side counts 0. Null and repeated wanted words count once.
    """
    from strandloom.functions.seq import reverse_complement

    each = wanted.select("kmer").where("kmer is not null").distinct()
    sides = each.select("kmer", F.col("kmer").alias("at"), F.lit(0).alias("side")).unionByName(each.select("kmer", reverse_complement(F.col("kmer")).alias("at"), F.lit(1).alias("side")))
    found = words.select(F.col("kmer").alias("at"), "acc", "cnt").join(sides, "at")
    count = lambda side: F.sum(F.when(F.col("side") == side, F.col("cnt")).otherwise(0))
    return found.groupBy("kmer", "acc").agg(count(0).alias("cnt"), count(1).alias("rc_cnt"))


def pop_words(words: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(popped, rest)``: the entries of the words ``taken(kmer)``, and the database without them."""
    each = taken.select("kmer").distinct()
    return words.join(each, "kmer", "left_semi"), words.join(each, "kmer", "left_anti")


def next_words(words: DataFrame) -> DataFrame:
    """``(k, kmer, next)``: the word behind each stored one in alphabetical order, null behind the last of its length.

    The window is over the different words of one length, at most 4^k rows.
    """
    each = words.select("k", "kmer").distinct()
    return each.withColumn("next", F.lead("kmer").over(W.partitionBy("k").orderBy("kmer")))


def merge_databases(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two databases ``(acc, k, x, y, kmer, cnt)`` as one: the counts of an entry of both are added."""
    both = a.select("acc", "k", "x", "y", "kmer", "cnt").unionByName(b.select("acc", "k", "x", "y", "kmer", "cnt"))
    return both.groupBy("acc", "k", "x", "y", "kmer").agg(F.sum("cnt").alias("cnt"))


def delete_genomes(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """``registry(acc, genome_id)`` without the accessions of ``gone(acc)``; the ids behind move up, so they stay 1..n."""
    left = registry.join(gone.select("acc").distinct(), "acc", "left_anti")
    return global_rank(left.drop("genome_id").withColumn("_was", F.lit(0)), [F.col("acc")], "genome_id").drop("_was")


def count_genomes(sequences: DataFrame, k: int, target: int, chunks: int) -> DataFrame:
    """``(acc, k, x, y, kmer, cnt, level)`` of genomes ``(acc, seq)``: depleted to ``target`` bases in ``chunks``, counted, levelled.

    Only the lower triangle x <= y is kept. Null accessions and sequences have no rows; a sequence shorter than ``target`` counts whole.
    """
    from strandloom.functions.seq import deplete, word_x, word_y
    from strandloom.operators.kmers import abundance, word_counts

    short = sequences.where("acc is not null and seq is not null").select("acc", deplete(F.col("seq"), target, chunks).alias("seq"))
    counts = abundance(word_counts(short, "acc", "seq", (k,)), k)
    placed = counts.select(F.col("id").alias("acc"), "k", word_x(F.col("kmer")).alias("x"), word_y(F.col("kmer")).alias("y"), "kmer", "cnt", "level")
    return placed.where("x <= y")


def upsert_genomes(words: DataFrame, sequences: DataFrame, k: int, target: int, chunks: int) -> DataFrame:
    """``words`` with the entries of length ``k`` of every genome in ``sequences(acc, seq)`` replaced by a new count of it (see ``count_genomes``)."""
    new = count_genomes(sequences, k, target, chunks)
    gone = sequences.where("acc is not null and seq is not null").select("acc").distinct().withColumn("k", F.lit(k))
    kept = words.join(gone, ["acc", "k"], "left_anti")
    return kept.select("acc", "k", "x", "y", "kmer", "cnt", "level").unionByName(new)


def without_repeats(ranked: DataFrame, value: str, most: int, *keys: str) -> DataFrame:
    """At most ``most`` words per key by ``value``; of neighbours in that order that are each other's reverse complement the first stays."""
    from strandloom.functions.seq import reverse_complement

    order = W.partitionBy(*keys).orderBy(F.desc(value), F.length("kmer"), "kmer")
    before = F.lag("kmer").over(order)
    kept = ranked.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != reverse_complement(F.col("kmer")))).drop("_b")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def median_gaps(words: DataFrame, reference: str) -> DataFrame:
    """Each genome against one: ``(acc, words, differing, most, median_gap)`` over the words that both hold.

    ``differing`` sums the thermometer bits in which the levels differ, ``most`` is three per word; ``median_gap`` is the mean distance of rank medians.
    """
    median = L.on_scale(F.col("level"), L.MEDIANS)
    known = words.where("level is not null").select("acc", "k", "kmer", "level", median.alias("m"))
    one = known.where(F.col("acc") == reference).select("k", "kmer", F.col("level").alias("rl"), F.col("m").alias("rm"))
    both = known.where(F.col("acc") != reference).join(one, ["k", "kmer"])
    gap = F.sum(F.abs(F.col("level") - F.col("rl")))
    return both.groupBy("acc").agg(F.count(F.lit(1)).alias("words"), gap.cast("bigint").alias("differing"), (3 * F.count(F.lit(1))).alias("most"), F.avg(F.abs(F.col("m") - F.col("rm"))).alias("median_gap"))
