"""Level vectors as packed bytes, and exact distances between blocks of them (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ENTRIES = 136
# Level codes and decoded values of level 0..3.
CODES = ("000", "001", "011", "111", "-2", "-1", "1", "2")


def parse_levels(values: pa.ListArray, entries: int = ENTRIES) -> np.ndarray:
    """Levels 0..3 per row; an entry that is missing, unreadable or behind the end of the list is 0, entries beyond ``entries`` are ignored."""
    flat = values.flatten()
    code = pc.index_in(pc.utf8_trim_whitespace(flat), value_set=pa.array(CODES)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint8) & 3
    length = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(values)), length)
    col = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((len(values), entries), np.uint8)
    keep = col < entries
    out[row[keep], col[keep]] = code[keep]
    return out


def packed(levels: np.ndarray) -> np.ndarray:
    """Two bits per entry, four entries per byte."""
    pad = np.zeros((len(levels), -(-levels.shape[1] // 4) * 4), np.uint8)
    pad[:, : levels.shape[1]] = levels
    return pad[:, 0::4] | pad[:, 1::4] << 2 | pad[:, 2::4] << 4 | pad[:, 3::4] << 6


def unpacked(data: np.ndarray, entries: int = ENTRIES) -> np.ndarray:
    """The inverse of ``packed``."""
    return np.stack([data >> s & 3 for s in (0, 2, 4, 6)], 2).reshape(len(data), -1)[:, :entries]


def as_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column of one width as a byte matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def as_binary(rows: np.ndarray) -> pa.Array:
    """A byte matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def thermometer(levels: np.ndarray) -> np.ndarray:
    """One 0/1 float per entry and level step; the Hamming distance of two is the sum of level differences."""
    return np.concatenate([levels >= 1, levels >= 2, levels >= 3], 1).astype(np.float32)


def bit_words(levels: np.ndarray) -> np.ndarray:
    """The thermometer code as 64-bit words."""
    bits = np.packbits(np.concatenate([levels >= 1, levels >= 2, levels >= 3], 1), axis=1)
    pad = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    pad[:, : bits.shape[1]] = bits
    return pad.view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute level differences between all rows of two thermometer blocks, by one matrix product."""
    return (a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int32)


def packed_vectors(df: DataFrame, id_col: str, values_col: str) -> DataFrame:
    """``(id, vec)`` for rows with an id and a list of at least one entry."""
    rows = df.select(id_col, values_col).where(f"{id_col} is not null and size({values_col}) > 0")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), as_binary(packed(parse_levels(batch.column(1))))], ["id", "vec"])

    return rows.mapInArrow(pack, "id bigint, vec binary")
