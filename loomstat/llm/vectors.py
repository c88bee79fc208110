"""What the operators on embeddings share: which vectors count, and their bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(c: str) -> Column:
    """Not null or empty, no null, NaN or infinite component, and not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def distinct(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row ``(vector, rep, copies)`` for each different usable vector; rep is its smallest id."""
    rows = df.where(usable(vector_col) & F.col(id_col).isNotNull())
    return rows.groupBy(F.col(vector_col).cast("array<double>").alias("vector")).agg(F.min(F.col(id_col).cast("long")).alias("rep"), F.count("*").alias("copies"))


def stacked(column) -> np.ndarray:
    """Rows of an Arrow list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
