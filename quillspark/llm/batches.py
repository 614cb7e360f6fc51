"""Batches of rows cut by the bytes of their texts; for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batches, most: int, column: str = "text"):
    """Slices of each batch with texts of ``most`` bytes together, or one longer text. Every row is in one slice."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(b):
            start = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, start + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; nulls are empty."""
    return [(t or "").encode() for t in batch.column(column).to_pylist()]


def slices(cells: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Binary cells of a buffer between consecutive offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cells) - 1, [None, pa.py_buffer(np.ascontiguousarray(cells, np.int64)), data])
