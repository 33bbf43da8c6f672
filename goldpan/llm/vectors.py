"""Vectors of an embeddings table, as the two searches read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether a vector is there and has only finite components, one at least."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as rows of doubles; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def width(vectors: DataFrame, col: str) -> int:
    """The largest number of components."""
    return vectors.agg(F.max(F.size(col))).first()[0] or 0


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def kept(s: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores with their ids; an id counts once, with its best score."""
    by = np.lexsort((-s, v))
    s, v = s[by], v[by]
    one = np.flatnonzero(np.r_[True, v[1:] != v[:-1]][: len(v)])
    best = one[best_rows(s[one], v[one], k)]
    return s[best], v[best]
