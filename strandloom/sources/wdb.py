"""Word databases on disk: Parquet by word length, text sections, matrices and result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.session import small


def save_wdb(words: DataFrame, path: str, title: str = "", version: str = "1", geometry: str = "lower") -> None:
    """Words by word length and a one-row metadata table; both are committed by the output protocol."""
    words.write.mode("overwrite").partitionBy("k").parquet(f"{path}/words")
    meta = words.sparkSession.createDataFrame([(title, version, geometry)], "title string, version string, geometry string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_wdb(spark: SparkSession, path: str, min_k: int | None = None, max_k: int | None = None) -> DataFrame:
    """Words of k in [min_k, max_k]; other lengths' files are not read."""
    words = spark.read.parquet(f"{path}/words")
    if min_k is not None:
        words = words.where(F.col("k") >= min_k)
    return words if max_k is None else words.where(F.col("k") <= max_k)


def wdb_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(title, version, geometry)``; a database without metadata has geometry whole."""
    try:
        return spark.read.parquet(f"{path}/meta")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([("", "", "whole")], "title string, version string, geometry string")


def wdb_text(words: DataFrame) -> DataFrame:
    """``value`` lines ``word|k|x|y|count|record`` of a text database; the record is ``acc:level`` pairs."""
    entry = F.concat_ws(":", "acc", F.coalesce(F.col("level").cast("string"), F.lit("")))
    rows = words.groupBy("kmer", "k", "x", "y").agg(F.sum("cnt").alias("cnt"), F.array_sort(F.collect_list(entry)).alias("r"))
    return rows.select(F.concat_ws("|", "kmer", F.col("k").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"), F.col("cnt").cast("string"), F.array_join("r", ";")).alias("value"))


def write_wdb_text(words: DataFrame, path: str, title: str, version: str = "1", min_k: int | None = None, max_k: int | None = None, supplementary: str = "", lineages: DataFrame | None = None) -> None:
    """A text database of words with k in [min_k, max_k], as one folder of files; every file repeats the short section headers, so each stands alone.

    ``lineages(acc, lineage)`` go to files of their own, with a #LINEAGES section of ``acc|lineage`` lines, beside an #ACCESSIONS section of the genomes.
    """
    if min_k is not None:
        words = words.where(F.col("k") >= min_k)
    if max_k is not None:
        words = words.where(F.col("k") <= max_k)
    head = f"#TITLE\n{title}\n#VERSION\n{version}\n#SUPPLEMENTARY\n{supplementary}\n#WORDS"
    parts = [("#ACCESSIONS", words.select(F.col("acc").alias("value")).distinct())]
    if lineages is not None:
        parts.append(("#LINEAGES", lineages.select(F.concat_ws("|", "acc", "lineage").alias("value"))))
    for name, rows in parts:
        rows = rows.withColumn("p", F.spark_partition_id())
        first = F.row_number().over(W.partitionBy("p").orderBy("value")) == 1
        rows.select(F.when(first, F.concat(F.lit(name + "\n"), "value")).otherwise(F.col("value")).alias("value")).write.mode("overwrite").text(f"{path}/{name[1:].lower()}")
    path = f"{path}/words"
    lines = wdb_text(words).withColumn("p", F.spark_partition_id())
    first = F.row_number().over(W.partitionBy("p").orderBy("value")) == 1
    lines.select(F.when(first, F.concat(F.lit(head + "\n"), "value")).otherwise(F.col("value")).alias("value")).write.mode("overwrite").text(path)


def read_wdb_text(spark: SparkSession, path: str) -> DataFrame:
    """``(kmer, k, x, y, cnt, acc, level)`` of the word lines of a text database; ``read_wdb_sections`` has the other sections.

    A word line is known by its shape (a word and four numbers), so no line needs the ones before it and the
    files can be read in any splits.
    """
    shape = r"^([ACGT]+)\|(\d+)\|(\d+)\|(\d+)\|(\d+)\|(.*)$"
    rows = spark.read.option("recursiveFileLookup", True).text(path).where(F.col("value").rlike(shape))
    part = lambda i: F.regexp_extract("value", shape, i)
    rows = rows.select(part(1).alias("kmer"), *[part(i + 2).cast(t).alias(c) for i, (c, t) in enumerate((("k", "int"), ("x", "int"), ("y", "int"), ("cnt", "bigint")))], F.explode(F.split(part(6), ";")).alias("e"))
    pair = F.split("e", ":")
    return rows.select("kmer", "k", "x", "y", "cnt", pair[0].alias("acc"), F.get(pair, F.lit(1)).try_cast("int").alias("level"))


MOST_COLUMNS = 20_000  # of a wide matrix: Spark plans a column each; a long table has no such limit


def column_titles(features: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """The marker titles that occur, in order; more than ``most`` are an error, none is left out."""
    rows = features.select("marker").distinct().orderBy("marker").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} columns: keep the long form")
    return [r["marker"] for r in rows]


def wide_matrix(features: DataFrame, titles: list[str], markers: list[str] | None = None) -> DataFrame:
    """One row per ``titles``, one column per marker; the columns are given or those that occur (checked to be at most 20,000)."""
    markers = column_titles(features) if markers is None else markers
    return features.groupBy(*titles).pivot("marker", markers).agg(F.first("value"))


def write_matrix(features: DataFrame, titles: list[str], path: str, sep: str = ",") -> None:
    """A wide matrix as CSV (or TSV) with a header."""
    wide_matrix(features, titles).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_matrix(spark: SparkSession, path: str, titles: list[str], sep: str = ",") -> DataFrame:
    """A wide matrix back in long form; blank and unreadable cells are 0, blank titles are dropped."""
    wide = spark.read.option("header", True).option("sep", sep).csv(path)
    cols = [c for c in wide.columns if c not in titles]
    long = wide.unpivot(titles, cols, "marker", "value").withColumn("value", F.coalesce(F.expr("try_cast(value as int)"), F.lit(0)))
    for t in titles:
        long = long.withColumn(t, F.trim(t)).where(F.col(t) != "")
    return long


def chunked(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``chunk`` (from 0): consecutive rows in chunks of ``size``."""
    from strandloom.operators.ranking import global_rank

    return global_rank(rows, [F.col(c) for c in order], "_r").withColumn("chunk", F.floor((F.col("_r") - 1) / size)).drop("_r")


def write_folders(rows: DataFrame, paths: DataFrame, path: str, key: str = "acc") -> None:
    """``rows`` sorted into a folder hierarchy: one folder per step of the tree path of their ``key``.

    ``paths(key, path)`` are pathways of a tree, ``Root>0>1>leaf``; the steps between root and
    leaf, joined by ``_``, name the folders (a dot would read back as a number). All members of a folder are written together; rows whose key has no path are left out.
    """
    steps = F.split("path", ">")
    folder = F.array_join(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 2, F.lit(0))), "_")
    at = paths.where("path is not null").select(key, F.when(folder == "", F.lit("root")).otherwise(folder).alias("folder"))
    rows.join(small(at), key).write.mode("overwrite").partitionBy("folder").parquet(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Result table Record, Taxon, Identity, Path, Species level as TSV."""
    cols = [F.col("record").alias("Record"), F.col("taxon").alias("Taxon"), F.format_string("%.4f", "identity").alias("Identity"), F.col("path").alias("Path"), F.col("species_level").alias("Species level")]
    hits.select(*cols).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def model_text(model: DataFrame) -> DataFrame:
    """Text lines of node models: marker and label means at four decimals."""
    cell = F.concat(F.col("label"), F.lit("="), F.format_string("%.4f", "mean"))
    rows = model.groupBy("node", "marker").agg(F.array_join(F.array_sort(F.collect_list(cell)), "\t").alias("m"))
    return rows.select(F.concat_ws("\t", "node", "marker", "m").alias("value"))


def value_rows(words: DataFrame) -> DataFrame:
    """Words with their values on the -2..2 scale, ready for ``wide_matrix``."""
    return words.withColumn("value", L.on_scale(F.col("level"), L.VALUES))


def read_wdb_sections(spark: SparkSession, path: str) -> DataFrame:
    """``(section, value)``: the different lines of all sections of a text database but its words, section names in lower case.

    A line belongs to the last header before it in its file. Only headers, title, version, notes, lineages and accessions take part in that
    order; the word lines, known by their shape, are left out before. Lines before the first header have a null section.
    """
    shape = r"^([ACGT]+)\|(\d+)\|(\d+)\|(\d+)\|(\d+)\|(.*)$"
    rows = spark.read.option("recursiveFileLookup", True).text(path).where((F.trim("value") != "") & ~F.col("value").rlike(shape))
    rows = rows.select(F.trim("value").alias("value"), F.input_file_name().alias("f"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("at"))
    header = F.when(F.col("value").rlike("^#[A-Z]+$"), F.lower(F.substr("value", F.lit(2))))
    order = W.partitionBy("f").orderBy("b", "at").rowsBetween(W.unboundedPreceding, 0)
    named = rows.withColumn("section", F.last(header, ignorenulls=True).over(order))
    return named.where(~F.col("value").rlike("^#[A-Z]+$")).select("section", "value").distinct()


def write_kmer_matrices(features: DataFrame, titles: list[str], path: str, min_k: int, max_k: int, columns: int = 4**6) -> None:
    """Wide matrices as CSV, one folder ``{k}_mers.{n}`` per word length in [min_k, max_k) and ``columns`` markers, in the order of the markers.

    ``features(titles, k, marker, value)``; a cell without a row is -2, the value of an absent word. Lengths without a marker have no folder.
    """
    for k in range(min_k, max_k):
        rows = features.where(F.col("k") == k)
        markers = column_titles(rows, 4**k)
        for n, at in enumerate(range(0, len(markers), columns)):
            part = markers[at : at + columns]
            wide_matrix(rows, titles, part).fillna(-2, part).write.mode("overwrite").option("header", True).csv(f"{path}/{k}_mers.{n}")


def sized_chunks(rows: DataFrame, text: str, order: list[str], most_bytes: int) -> DataFrame:
    """Adds ``chunk``: consecutive rows of a partition whose texts together begin within ``most_bytes`` of each other.

    Rows are range-partitioned by ``order`` and a running sum of text sizes is cut inside each partition, so chunks of different partitions have
    different numbers and no task sees all rows. A chunk holds at most ``most_bytes`` and one row's text more; a null text counts nothing.
    """
    placed = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    before = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    size = F.coalesce(F.octet_length(text), F.lit(0))
    sofar = F.coalesce(F.sum(size).over(before), F.lit(0))
    return placed.withColumn("chunk", F.concat_ws("-", F.col("_p").cast("string"), F.floor(sofar / most_bytes).cast("string"))).drop("_p")


def genome_chunks(values: DataFrame, size: int) -> DataFrame:
    """``(name, chunk, first, last, values)``: each genome's values in chunks of ``size``, with the 0-based places of a chunk's ends.

    ``values(name, pos, value)``; a chunk is one row of at most ``size`` values.
    """
    cells = values.select("name", F.floor(F.col("pos") / size).alias("chunk"), F.struct("pos", "value").alias("c"))
    rows = cells.groupBy("name", "chunk").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return rows.select("name", "chunk", F.col("c")[0]["pos"].alias("first"), F.element_at("c", -1)["pos"].alias("last"), F.transform("c", lambda c: c["value"]).alias("values"))
