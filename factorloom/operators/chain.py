"""Chaining the models of two instances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import matrix
from ..functions.vectors import dot


def ytx_partial(y: DataFrame, other_x: DataFrame) -> DataFrame:
    """(r, features): y[r] * x of every id that both have; ids of one side only are ignored."""
    both = y.select("id", F.col("features").alias("_y")).join(other_x.select("id", F.col("features").alias("_x")), "id")
    return both.select(F.posexplode("_y").alias("r", "_v"), "_x").select("r", F.transform("_x", lambda v: v.cast("double") * F.col("_v").cast("double")).alias("features"))


def ytx(y: DataFrame, other_x: DataFrame) -> DataFrame:
    """(r, features): the rows of Y'X. Each task adds up y x' of its ids, so k² sums a task are shuffled, not k² an id."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0)).T @ matrix(b.column(1))
                total = m if total is None else total + m
        if total is not None:
            r, c = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(total.ravel())], ["r", "c", "v"])

    both = y.select("id", F.col("features").alias("_y")).join(other_x.select("id", F.col("features").alias("_x")), "id").where("_x is not null and _y is not null").select("_y", "_x")
    cells = both.mapInArrow(partial, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v"))
    return cells.groupBy("r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("features"))


def merged_y(matrix: DataFrame, other_y: DataFrame) -> DataFrame:
    """(id, features): Y'X times each of the other instance's item vectors. The matrix is k rows; they must be contiguous from 0."""
    rows = matrix.orderBy("r").collect()
    if [r.r for r in rows] != list(range(len(rows))):
        raise ValueError("rows of the matrix are missing")
    literal = [F.array(*[F.lit(float(v)) for v in r.features]) for r in rows]
    return other_y.select("id", F.array(*[dot(F.col("features"), m) for m in literal]).alias("features"))
