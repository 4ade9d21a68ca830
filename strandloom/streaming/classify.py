"""Classification of reads as they arrive: the scoring is stateless, so a stream runs the batch code per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.classify import agreement, read_marker_values


def classify_stream(spark: SparkSession, folder: str, schema: str, markers: DataFrame, model: DataFrame, ks: tuple[int, ...], out: str, checkpoint: str, id_col: str = "record_id", seq_col: str = "seq", files_per_trigger: int = 10) -> StreamingQuery:
    """Reads Parquet files of ``(id, seq)`` arriving in ``folder`` and appends ``(id, label, score)`` to ``out``.

    A micro-batch that is repeated after a failure rewrites its own ``batch`` partition, so results stay exactly-once.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)

    def score(batch: DataFrame, number: int) -> None:
        values = read_marker_values(batch, id_col, seq_col, markers, ks)
        agreement(values, model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hit_rates(events: DataFrame, time: str, taxon: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Hits per taxon and window over a stream (or batch) with a watermark for late rows."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, window), taxon).agg(F.count(F.lit(1)).alias("hits")).select(F.col("window.start").alias("day"), taxon, "hits")
