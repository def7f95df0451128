"""Vectors as whole numbers: which rows take part, their integers, and an Arrow list column as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1 << 40  # integers beyond it are set to it, so that products and their sums stay within 38 digits


def usable(vector: Column) -> Column:
    """True for a vector that is not null and holds neither null nor a number that is not finite; an empty one is usable."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry c, taken as double, as long, held to LIMIT on both sides."""
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * F.lit(float(scale))), F.lit(LIMIT)), F.lit(-LIMIT)))


def padded(vector: Column, dims: int) -> Column:
    """The vector with zeros behind it up to dims entries."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(vector)))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of long integers, with zeros behind those that are shorter than dims."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out
