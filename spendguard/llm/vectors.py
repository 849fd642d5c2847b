"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def all_finite(vector: Column) -> Column:
    """True where the vector and all its components are there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine), F.lit(False))


def matrices(column: pa.ListArray):
    """(rows, matrix) for every length of vector in the column: row numbers and their vectors, stacked."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    lengths = column.value_lengths().to_numpy()
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)]
