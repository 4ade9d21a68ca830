"""Problem 7: mixing sources to target weights."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.names import source_key
from strandloom.llm.worker import kept
from strandloom.session import cut_lineage, small, table, wide

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of byte-level BPE.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text_col: str, path: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """``df`` without its text, with the number of tokens of each whole text; a null text has 0."""
    keep = [c for c in df.columns if c != text_col]
    schema = df.select(*keep, F.lit(0).cast("bigint").alias(out)).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = kept(f"tiktoken {path}", lambda: _encoding(path))
            texts = batch.column(len(keep)).to_pylist()
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [*keep, out])

    return df.select(*keep, text_col).mapInArrow(count, schema)


def source_sizes(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, size)`` of every target; a source without rows has size 0.

    ``docs(source, tokens)``. Names match without case and outer blanks, a blank for an
    underscore; documents without a source, or of a source without target, do not count.
    """
    sums = docs.where("source is not null").groupBy(source_key(F.col("source")).alias("k")).agg(F.sum("tokens").alias("size"))
    sums = cut_lineage(sums)  # a row per spelling-free source name: the count behind `small` must not tokenise again
    wanted = targets.select("source", "target_share", "max_repeats", source_key(F.col("source")).alias("k"))
    return wanted.join(small(sums), "k", "left").select("source", "target_share", "max_repeats", F.coalesce("size", F.lit(0)).alias("size"))


def water_filled(sizes: DataFrame, total: float | None = None) -> DataFrame:
    """Adds ``total``, ``amount`` (tokens to take), ``epochs`` and ``capped`` to ``source_sizes``.

    Sources whose cap (max_repeats * size) lies under their share are clamped and what they
    lack goes to the others in proportion to their shares, until none is over its cap: in order
    of cap / share the level (total - clamped caps) / (remaining shares) tells how many are clamped.
    The mixture is ``total`` tokens, by default the sum of the sizes; if all are clamped it is
    smaller. The windows run over the rows of the target table only. Null shares or repeats count as 0.
    """
    everything = F.sum("size").over(W.partitionBy()) if total is None else F.lit(float(total))
    cap = F.coalesce("max_repeats", F.lit(0)) * F.col("size")
    base = sizes.withColumn("total", everything.cast("double")).withColumn("_cap", cap.cast("double")).withColumn("_share", F.coalesce("target_share", F.lit(0.0)))
    base = base.withColumn("_ratio", F.when(F.col("_share") > 0, F.col("_cap") / F.col("_share")).otherwise(F.lit(float("inf"))))
    order = W.partitionBy().orderBy("_ratio", "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    share = F.sum("_share").over(order.rowsBetween(0, W.unboundedFollowing))
    base = base.withColumn("_level", F.when(share > 0, F.greatest(left, F.lit(0.0)) / share).otherwise(F.lit(0.0)))
    base = base.withColumn("_over", (F.col("_share") > 0) & (F.col("_ratio") < F.col("_level")))
    # the first source in order that is not over its cap sets the level for all behind it
    level = F.min(F.when(~F.col("_over"), F.struct("_ratio", "source", "_level"))).over(W.partitionBy())["_level"]
    base = base.withColumn("_final", F.coalesce(level, F.lit(float("inf"))))
    amount = F.when(F.col("_over"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_share") * F.col("_final")))
    base = base.withColumn("amount", amount).withColumn("epochs", F.when(F.col("size") > 0, amount / F.col("size")).otherwise(F.lit(0.0)))
    short = F.col("_cap") < F.col("_share") * F.col("total")
    return base.select(*sizes.columns, "total", "amount", "epochs", F.col("_over").alias("capped"), short.alias("short"))


def mix_sources(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """``(id, copy, source, tokens)``: every document floor(epochs) times and a seeded fraction once more."""
    amounts = plan.select(source_key(F.col("source")).alias("k"), F.col("source").alias("mix_source"), "epochs")
    known = docs.select(id_col, "source", "tokens").where("source is not null").withColumn("k", source_key(F.col("source"))).join(small(amounts), "k")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor("epochs")
    copies = (whole + F.when(draw < F.col("epochs") - whole, 1).otherwise(0)).cast("int")
    rows = known.withColumn("copies", copies).where("copies > 0")
    return rows.select(id_col, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), F.col("mix_source").alias("source"), "tokens")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(wide(table(spark, d, "documents").select("doc_id", "source", "text")), "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share within their repeats."""
    plan = water_filled(source_sizes(_docs(spark, d), table(spark, d, "mix_targets")))
    return plan.where("short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares wanted and really reached by the mixture, per source."""
    docs = cut_lineage(_docs(spark, d))
    plan = cut_lineage(water_filled(source_sizes(docs, table(spark, d, "mix_targets"))))
    got = mix_sources(docs, plan).groupBy("source").agg(F.sum("tokens").alias("got"))
    joined = plan.join(small(got), "source", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    share = F.col("got") / F.sum("got").over(W.partitionBy())
    return joined.select("source", "size", "target_share", "max_repeats", "epochs", "capped", "got", share.alias("share"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: one row per document and copy."""
    docs = cut_lineage(_docs(spark, d))
    return mix_sources(docs, water_filled(source_sizes(docs, table(spark, d, "mix_targets"))))
