"""Numpy kernels that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.ChunkedArray | pa.Array, k: int | None = None, dtype=np.float64) -> np.ndarray:
    """Rows of a list column without nulls as a matrix. Copies no Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, k or 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


def lists(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A matrix as a list column."""
    n, k = values.shape
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), type=kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), flat)


def gramian_rows(df: DataFrame, column: str) -> DataFrame:
    """Sum of v vᵀ over all rows as (r, c, v): one partial matrix for each partition, added by Spark, k² rows in the end.

    Rows with a null vector don't count. An empty table gives no rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0))
                total = m.T @ m + (0 if total is None else total)
        if total is not None:
            r, c = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(total.ravel())], ["r", "c", "v"])

    parts = df.select(column).where(F.col(column).isNotNull()).mapInArrow(partial, "r int, c int, v double")
    return parts.groupBy("r", "c").agg(F.sum("v").alias("v"))


def gramian(df: DataFrame, column: str, k: int) -> np.ndarray:
    """The k×k Gramian on the driver: k² numbers, whatever the size of the table."""
    out = np.zeros((k, k))
    for row in gramian_rows(df, column).collect():
        out[row.r, row.c] = row.v
    return out


def full_rank(gram: np.ndarray) -> bool:
    return bool(np.isfinite(gram).all() and np.linalg.matrix_rank(gram, hermitian=True) == len(gram))


def seeded_normals(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Gaussian rows that depend on the id and the seed alone, so that partitioning doesn't matter."""
    base = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = base + (np.arange(2 * k, dtype=np.uint64) + np.uint64(seed * 7919 + 1)) * np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * np.pi * u[:, k:])
