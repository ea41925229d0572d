"""What the operators on vectors share: which vectors take part, and their values as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding"):
    """Not null, not empty, not all zero, and every component a finite number."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def as_rows(column) -> np.ndarray:
    """An array column (pandas or Arrow) as a matrix of doubles; shorter vectors are filled up with zeros."""
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    widths = set(map(len, values))
    if len(widths) == 1:
        whole = isinstance(values[0], np.ndarray) and values[0].dtype.kind == "i"
        return np.array(values, dtype="int64" if whole else "float64")
    width = max(widths, default=0)
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def widest(table: DataFrame, column: str = "embedding") -> int:
    return table.agg(F.max(F.size(column))).first()[0] or 0
