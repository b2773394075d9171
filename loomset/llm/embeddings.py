"""Vectors of whole numbers, as the vector operators read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each entry c of a vector becomes floor(SCALE * c).
SCALE = 256


def whole(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of a vector's entries, as longs; null where the vector or an entry is null, or one isn't finite."""
    entries = vec.cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * scale).cast("long")))


def padded(rows: DataFrame, col: str = "x") -> tuple[DataFrame, int]:
    """The rows with vectors of one length (shorter ones end in zeros), and that length; 0 without rows."""
    least, width = rows.agg(F.min(F.size(col)), F.max(F.size(col))).first()
    if width and least < width:
        rows = rows.withColumn(col, F.concat(col, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(col))))
    return rows, width or 0


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as rows of an array of longs."""
    return np.asarray(col.flatten(), np.int64).reshape(len(col), width)
