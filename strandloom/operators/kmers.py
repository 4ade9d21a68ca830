"""Word counts of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.levels import level_of
from strandloom.functions.seq import clean_seq
from strandloom.session import wide

_BASE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _i


def word_of_code(code: Column, k: int) -> Column:
    """Letters of a base-4 code with A=0, C=1, G=2, T=3."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def word_counts(df: DataFrame, id_col: str, seq_col: str, ks: tuple[int, ...], include_last: bool = True) -> DataFrame:
    """``(id, k, kmer, cnt, length)``: overlapping words of only A, C, G, T in each cleaned sequence.

    The sequence is upper-cased and freed of white space; ``length`` counts all its characters.
    ``include_last=False`` leaves out the word at the last position. Counting is one pass of rolling codes over the bytes of a
    sequence, already summed per sequence when rows leave the task, so the shuffle behind carries counts and
    not positions. Null ids and sequences have no rows, nor do sequences shorter than k.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(seq_col).isNotNull()).select(F.col(id_col).alias("id"), clean_seq(F.col(seq_col)).alias("seq"))
    kind = rows.schema["id"].dataType.simpleString()
    cut = 0 if include_last else 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, ks_out, codes, counts, lengths = [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                base = _BASE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
                n = len(base)
                bad = np.concatenate([[0], np.cumsum(base == 4)])
                for k in ks:
                    if n - cut < k:
                        continue
                    code = np.zeros(n - k + 1 - cut, np.int64)
                    for i in range(k):
                        code = code << 2 | (base[i : i + len(code)] & 3)
                    code = code[(bad[k : k + len(code)] - bad[: len(code)]) == 0]
                    value, number = np.unique(code, return_counts=True)
                    which.append(np.full(len(value), r))
                    ks_out.append(np.full(len(value), k, np.int32))
                    codes.append(value)
                    counts.append(number)
                    lengths.append(np.full(len(value), len(text), np.int64))
            if which:
                at = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(np.concatenate(x)) for x in (ks_out, codes, counts, lengths))], ["id", "k", "code", "cnt", "length"])

    out = wide(rows).mapInArrow(count, f"id {kind}, k int, code bigint, cnt bigint, length bigint")
    word = None
    for k in ks:
        word = F.when(F.col("k") == k, word_of_code(F.col("code"), k)) if word is None else word.when(F.col("k") == k, word_of_code(F.col("code"), k))
    return out.select("id", "k", word.alias("kmer"), "cnt", "length")


def group_spectrum(counts: DataFrame) -> DataFrame:
    """Counts of all sequences together: ``(k, kmer, cnt, sequences)``."""
    return counts.groupBy("k", "kmer").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("sequences"))


def abundance(counts: DataFrame, k: int) -> DataFrame:
    """Adds the level 0..3 of each count of words of length ``k``."""
    return counts.where(F.col("k") == k).withColumn("level", level_of(k, F.col("cnt"), F.col("length")))
