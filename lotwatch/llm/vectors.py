"""Vectors of a table as rows of numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(vector: Column) -> Column:
    """Whether a vector isn't null and holds finite numbers only (true for an empty one)."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def padded(vector: Column, width: int, fill) -> Column:
    """vector with so many entries, those that it lacks being `fill`."""
    return F.when(F.size(vector) == width, vector).otherwise(F.concat(vector, F.array_repeat(F.lit(fill), F.lit(width) - F.size(vector))))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have this width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())
