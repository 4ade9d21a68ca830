"""Problem 3: cutting oversized items at natural boundaries by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.session import cut_lineage, table

LIMIT, OVERLAP, UNKNOWN_RUN = 4000, 100, 20


def boundary_ends(seq: Column, run: int = UNKNOWN_RUN) -> Column:
    """End positions (1-based) of the unknown stretches that have bases on both sides.

    A stretch is a maximal run of at least ``run`` characters other than A, C, G, T in either
    case. Pieces between stretches and the stretches themselves alternate, so positions are
    running sums of their lengths; everything stays inside the JVM. Null gives null.
    """
    unknown = f"[^ACGTacgt]{{{run},}}"
    between = F.split(seq, unknown, -1)
    runs = F.regexp_extract_all(seq, F.lit(unknown), F.lit(0))
    steps = F.transform(runs, lambda r, i: F.struct(F.length(F.get(between, i)).alias("bases"), F.length(r).alias("run")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def add(acc: Column, s: Column) -> Column:
        end = acc["at"] + s["bases"] + s["run"]
        inner = (acc["at"] + s["bases"] > 0) & (end < F.length(seq))
        return F.struct(end.alias("at"), F.when(inner, F.concat(acc["ends"], F.array(end))).otherwise(acc["ends"]).alias("ends"))

    return F.aggregate(steps, start, add)["ends"]


def successors(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every boundary of ``items(kind, id, n, ends)`` with its farthest legal successor.

    Result ``(kind, id, n, at, to, hard)``: from a piece end ``at`` (0 is the start of the item)
    the greedy cut reaches the piece end ``to`` after ``hard`` cuts where no boundary was in
    reach. A piece after the first begins ``overlap`` positions before the previous end, so a
    step gains limit - overlap. Only items longer than ``limit`` have rows; null ids, null
    lengths and null ``ends`` (taken as no boundary) are allowed, repeated rows count once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    step = limit - overlap
    inner = F.coalesce("ends", F.array().cast("array<int>"))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(inner, lambda e: e.cast("bigint")), F.array(F.col("n").cast("bigint")))
    nodes = items.where((F.col("n") > limit) & F.col("id").isNotNull()).select("kind", "id", F.col("n").cast("bigint").alias("n"), F.explode(ends).alias("at")).distinct()
    first = F.when(F.col("at") == 0, F.lit(limit)).otherwise(F.lit(step))
    nodes = nodes.withColumn("next", F.lead("at").over(W.partitionBy("kind", "id").orderBy("at")))
    over = F.greatest(F.lit(0), F.ceil((F.col("next") - F.col("at") - first) / F.lit(step)))
    reach = nodes.where("next is not null").withColumn("hard", over.cast("bigint"))
    reach = reach.withColumn("reach", F.col("at") + first + F.col("hard") * step)
    # the farthest boundary lies less than a limit before the reach: three buckets of a step hold it
    buckets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.floor(F.col("reach") / F.lit(step)) - i))
    targets = nodes.select("kind", "id", F.col("at").alias("to"), F.floor(F.col("at") / F.lit(step)).alias("bucket"))
    near = reach.withColumn("bucket", buckets).join(targets, ["kind", "id", "bucket"]).where("to > at and to <= reach")
    return near.groupBy("kind", "id", "n", "at", "hard").agg(F.max("to").alias("to"))


def chain_ends(table_: DataFrame) -> DataFrame:
    """``(kind, id, n, at, end)``: where the greedy cutting from each boundary of ``successors`` comes to its end.

    Pointer doubling: each round replaces the end of a chain by the end of the chain that begins there, so the rounds are
    the logarithm of the longest chain, for all items together. An end other than ``n`` would be a boundary without a successor.
    """
    base = cut_lineage(table_.select("kind", "id", "n", "at", F.col("to").alias("end")))
    while True:
        further = base.select("kind", "id", F.col("at").alias("end"), F.col("end").alias("further"))
        base = cut_lineage(base.join(further, ["kind", "id", "end"], "left").select("kind", "id", "n", "at", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")))
        moved = not base.where("moved").isEmpty()
        base = base.drop("moved")
        if not moved:
            return base


def greedy_cuts(table_: DataFrame) -> DataFrame:
    """The rows of ``successors`` that the greedy cutting from position 0 visits.

    Pointer doubling: after i rounds the reached set holds the first 2^i ends of every item
    and the jump table spans 2^i steps; both are joined with the jump table once a round, so
    the rounds are the logarithm of the longest chain, for all items together.
    """
    base = cut_lineage(table_)
    jump = base.select("kind", "id", "at", "to")
    reached = base.where("at = 0").select("kind", "id", "at")
    size = reached.count()
    while True:
        new = reached.join(jump, ["kind", "id", "at"]).select("kind", "id", F.col("to").alias("at"))
        reached = cut_lineage(reached.union(new).distinct())
        now = reached.count()
        if now == size:
            break
        size = now
        second = jump.select("kind", "id", F.col("at").alias("to"), F.col("to").alias("end"))
        jump = cut_lineage(jump.join(second, ["kind", "id", "to"]).select("kind", "id", "at", F.col("end").alias("to")))
    return base.join(reached, ["kind", "id", "at"], "left_semi")


def split_pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces ``(kind, id, piece, start, stop, natural)`` of all items longer than ``limit``.

    Positions are 1-based and inclusive, a piece has at most ``limit`` positions, consecutive
    pieces share ``overlap``. ``natural`` tells whether the piece ends at a boundary or the
    item's end. Pieces are the greedy ones: each ends at the farthest boundary in reach, and
    only where none is in reach at the limit itself. Items up to the limit have no rows.
    """
    step = limit - overlap
    first = F.when(F.col("at") == 0, F.lit(limit)).otherwise(F.lit(step))
    cuts = greedy_cuts(successors(items, limit, overlap))
    cut = cuts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("hard"))))
    stop = F.when(F.col("i") == F.col("hard"), F.col("to")).otherwise(F.col("at") + first + F.col("i") * step)
    before = F.when(F.col("i") == 0, F.col("at")).otherwise(F.col("at") + first + (F.col("i") - 1) * step)
    pieces = cut.select("kind", "id", F.greatest(before - overlap + 1, F.lit(1)).alias("start"), stop.alias("stop"), (F.col("i") == F.col("hard")).alias("natural"))
    number = F.row_number().over(W.partitionBy("kind", "id").orderBy("stop"))
    return pieces.select("kind", "id", number.alias("piece"), "start", "stop", "natural")


def oversized(spark: SparkSession, d: str, limit: int = LIMIT) -> DataFrame:
    """Oversized records and genomes as ``items`` of ``successors``; genomes have no sequence, so no boundary."""
    long = table(spark, d, "fasta_records").select("record_id", "seq").where(F.length("seq") > limit)
    clean = long.select(F.lit("record").alias("kind"), F.col("record_id").alias("id"), F.regexp_replace("seq", r"\s+", "").alias("seq"))
    records = clean.where(F.length("seq") > limit).select("kind", "id", F.length("seq").cast("bigint").alias("n"), boundary_ends(F.col("seq")).alias("ends"))
    genomes = table(spark, d, "genomes").where(F.col("seqlength") > limit)
    none = F.array().cast("array<int>")
    return records.unionByName(genomes.select(F.lit("genome").alias("kind"), F.col("genome_key").alias("id"), F.col("seqlength").alias("n"), none.alias("ends")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Natural boundaries of oversized records: those from which the cutting reaches the record's end."""
    cuts = chain_ends(successors(oversized(spark, d).where("kind = 'record'"))).where("at > 0 and end = n")
    return cuts.select(F.col("id").alias("record_id"), (F.col("at") + 1).alias("cut_pos"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of oversized records and genomes."""
    return split_pieces(oversized(spark, d))
