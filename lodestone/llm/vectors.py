"""Embeddings as Arrow columns and numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_by_length(column: pa.Array):
    """For each length of vector: the rows that have it and their numbers as
    doubles; rows that are null, empty or hold null or non-finite numbers are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    flat = column.values
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if flat.null_count:
        values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, values)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        v = values[offsets[rows][:, None] + np.arange(n)]
        good = np.isfinite(v).all(axis=1)
        if good.any():
            yield rows[good], v[good]


def packed(n: int, found) -> list[bytes | None]:
    """n rows of bytes or null from (rows, matrix) pairs."""
    out: list[bytes | None] = [None] * n
    for rows, matrix in found:
        for i, row in zip(rows.tolist(), np.ascontiguousarray(matrix), strict=True):
            out[i] = row.tobytes()
    return out


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of equally many bytes as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)
