"""Session, table loading and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "strandloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (AQE, UTC, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; pruning and pushdown are left to the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the folder that all executors share.

    The folder is the one named in ``spark.checkpoint.dir``. Only where that is unset and the
    session is local is a folder of our own made; on a cluster an unset folder is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoint")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=eager)


def wide(df: DataFrame, per_slot: int = 1) -> DataFrame:
    """Spread a source of few partitions over the cluster before per-row work that costs far more than a shuffle.

    A source that already has a partition for every core is returned untouched. The target follows
    the cluster's cores, so that the same call neither floods a laptop nor starves a cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df if have >= cores * per_slot else df.repartition(cores * per_slot)


def small(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it has at most ``most_rows`` rows, else unmarked.

    Beyond the limit the join is an ordinary shuffled one with the same result.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def each_of(df: DataFrame, values: DataFrame, col: str, most_rows: int = 70_000) -> DataFrame:
    """Every row of ``df`` with every value of the one-column ``values``: the dense cells of a matrix.

    The values, checked to be at most ``most_rows``, travel as one row that is exploded again.
    """
    if values.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} columns")
    one = values.agg(F.sort_array(F.collect_set(col)).alias("_each"))
    return df.crossJoin(F.broadcast(one)).withColumn(col, F.explode("_each")).drop("_each")  # one-row side
