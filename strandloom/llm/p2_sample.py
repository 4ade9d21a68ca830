"""Problem 2: a sample whose category shares follow given targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.names import accession_key, genus_key, rank_name_key
from strandloom.operators.ranking import global_rank
from strandloom.session import small, table


def target_report(members: DataFrame, targets: DataFrame, units: float) -> DataFrame:
    """Per target category: available units, wanted units and whether it falls short.

    ``members(unit, category)`` may repeat rows; null units or categories count for nothing.
    ``targets(category, target_share, min_rows)``; a null share or minimum counts as 0, a
    category without members has 0 available. wanted = greatest(min_rows, target_share * units).
    """
    known = small(targets.select("category").distinct())
    counted = members.select("unit", "category").join(known, "category", "left_semi").distinct().groupBy("category").agg(F.count("unit").alias("available"))
    wanted = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("double"), F.coalesce("target_share", F.lit(0.0)) * F.lit(float(units)))
    return (
        targets.select("category", "target_share", "min_rows").join(counted, "category", "left")
        .select("category", "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"), wanted.alias("wanted"))
        .withColumn("short", F.col("available") < F.col("wanted"))
    )


def sample_to_targets(members: DataFrame, targets: DataFrame, units: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)``: floor(units) units drawn by divisor-method priorities.

    Each category's units get a random rank r and the priority (r - 0.5) / target_share; the
    first ``min_rows`` of a category come before all priorities. The smallest priorities are
    kept, so seats that an exhausted category cannot fill go to the others by themselves. A
    unit of several categories is drawn for the one with the least supply for its wish.
    Ranks are taken with ``global_rank``: a category that holds a third of all rows is no
    single task. Same seed, same sample; ties fall to the smaller hash, then the unit.
    Empty members or targets give an empty sample and a report with nothing available. The report's ``missing`` are whole
    units wanted but not drawn, whatever the cause: too few available, shared units that another category drew, or
    floors that together exceed the seats.
    """
    report = target_report(members, targets, units)
    supply = report.select("category", "target_share", "min_rows", "available", F.coalesce(F.try_divide(F.col("available"), F.col("wanted")), F.lit(float("inf"))).alias("_plenty"))
    own = (
        members.select("unit", "category")
        .where("unit is not null")
        .join(small(supply), "category")
        .groupBy("unit")
        .agg(F.min(F.struct("_plenty", "category", "target_share", "min_rows")).alias("_c"))
        .select("unit", "_c.category", "_c.target_share", "_c.min_rows", F.xxhash64(F.lit(seed), F.col("unit").cast("string")).alias("_h"))
    )
    placed = global_rank(own, [F.col("category"), F.col("_h"), F.col("unit")], "_place")
    first = placed.groupBy("category").agg(F.min("_place").alias("_first"))
    rank = F.col("_place") - F.col("_first") + 1
    share = F.coalesce("target_share", F.lit(0.0))
    ranked = (
        placed.join(small(first), "category")
        .withColumn("category_rank", rank)
        .withColumn("priority", F.when(rank <= F.coalesce("min_rows", F.lit(0)), F.lit(0.0)).when(share > 0, (rank - 0.5) / share))
        .where("priority is not null")
    )
    seated = global_rank(ranked, [F.col("priority"), F.col("_h"), F.col("unit")], "seat").where(F.col("seat") <= F.lit(int(units)))
    sample = seated.select("unit", "category", "category_rank", "priority")
    drawn = sample.groupBy("category").agg(F.count(F.lit(1)).alias("drawn"))
    full = report.join(small(drawn), "category", "left").fillna(0, ["drawn"])
    missing = F.greatest(F.floor("wanted") - F.col("drawn"), F.lit(0)).cast("bigint")
    return sample, full.withColumn("missing", missing)


def _lineage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, float]:
    """Members, targets and requested size for genomes by lineage."""
    targets = table(spark, d, "taxon_targets").where("field_name = 'lineage'")
    names = targets.select("category", F.explode(F.array("category", "former_name")).alias("name")).where("name is not null")
    names = names.select("category", rank_name_key(F.col("name")).alias("name")).distinct()
    genomes = table(spark, d, "genomes").select(accession_key(F.col("accession")).alias("unit"), "lineage").where("unit is not null")
    element = genomes.select("unit", F.explode(F.split("lineage", r"\|")).alias("name")).select("unit", rank_name_key(F.col("name")).alias("name"))
    members = element.join(small(names), "name").select("unit", "category").distinct()
    return members, targets, 0.2 * genomes.select("unit").distinct().count()


def _taxon(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, float]:
    """Members, targets and requested size for read hits by taxon."""
    targets = table(spark, d, "taxon_targets").where("field_name = 'taxon'")
    names = targets.select("category", F.explode(F.array("category", "former_name")).alias("name")).where("name is not null")
    names = names.select("category", genus_key(F.col("name")).alias("name")).distinct()
    hits = table(spark, d, "read_hits").select(F.col("record_id").alias("unit"), genus_key(F.col("taxon")).alias("name")).where("unit is not null")
    members = hits.join(small(names), "name").select("unit", "category").distinct()
    return members, targets, 0.1 * hits.select("unit").distinct().count()


FIELDS = {"lineage": _lineage, "taxon": _taxon}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that cannot be met: available < greatest(min_rows, target_share * n), and the sample stays below them."""
    out = []
    for field, load in FIELDS.items():
        report = sample_to_targets(*load(spark, d))[1]
        out.append(report.where("short and drawn < wanted").select(F.lit(field).alias("field_name"), "category"))
    return out[0].unionByName(out[1])


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares wanted and reached by the sample, per field and category."""
    out = [sample_to_targets(*load(spark, d))[1].select(F.lit(field).alias("field_name"), "category", "available", "wanted", "drawn", "missing", "short") for field, load in FIELDS.items()]
    return out[0].unionByName(out[1])


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The samples themselves: accession keys of genomes, record ids of read hits."""
    out = [sample_to_targets(*load(spark, d))[0].select(F.lit(field).alias("field_name"), F.col("unit").cast("string").alias("unit"), "category") for field, load in FIELDS.items()]
    return out[0].unionByName(out[1])
