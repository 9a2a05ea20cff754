"""Which vectors count, and their columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vec_col: str) -> F.Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blobs(rows: np.ndarray) -> pa.Array:
    """Rows as binaries, which :func:`stacked` reads."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def stacked(blobs, dtype=np.float64) -> np.ndarray:
    """Rows of a column of equally long binaries."""
    data = np.frombuffer(b"".join(blobs), dtype=dtype)
    return data.reshape(len(blobs), -1) if len(blobs) else np.zeros((0, 0), dtype=dtype)


def sample(df: DataFrame, id_col: str, vec_col: str, rows: int) -> np.ndarray:
    """About ``rows`` vectors at most, chosen by the hash of their id, ordered by content."""
    count = df.count()
    if count > rows:
        df = df.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * rows / count))
    got = [r[0] for r in df.select(F.col(vec_col).cast("array<double>")).collect()]
    return np.array(sorted(got)) if got else np.zeros((0, 0))
