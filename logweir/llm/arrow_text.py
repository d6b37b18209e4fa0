"""Texts of Arrow batches in pieces of bounded size, and their bytes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text comes alone.
BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive slices of at most ``most`` bytes in ``column``, or of one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in a row (null: empty) and the offsets of its rows in them."""
    column = pc.fill_null(column, "")
    column = column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    """A text column as Python strings, null as empty."""
    return pc.fill_null(column, "").to_pylist()
