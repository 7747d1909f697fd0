"""Most frequent values of a column in bounded memory, by combinatorial group testing.

Each of DEPTH rows of a sketch hashes a value to one of WIDTH buckets, and every bucket counts its rows in total and those with each of the 64 bits set.
Where one value makes up more than half of a bucket, the bits of the majority spell it. Sketches of partitions are added; they have a fixed size,
whatever the number of values. Decoded candidates are counted exactly in a second pass. A value that was missed would leave, in every row of the sketch, a
bucket whose rest reaches the threshold; if each row has such buckets, the values that fall into them in all rows are counted exactly, as a distributed
table, so nothing is missed and nothing unbounded comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
DEPTH, WIDTH = 4, 2048


def _bucket(item: Column, row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(item, F.lit(7919 * row + 11)), F.lit(width)).cast("int")


def sketch(df: DataFrame, item: str, depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """Counters [depth, width, 1 + 64] of a BIGINT column: total, then one for each bit. Nulls don't count. The size doesn't depend on the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((depth, width, 1 + BITS), np.int64)
        shifts = np.arange(BITS, dtype=np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            u, first, c = np.unique(b.column(0).to_numpy(), return_index=True, return_counts=True)
            bits = ((u.view(np.uint64)[:, None] >> shifts) & np.uint64(1)).astype(np.int64)
            block = np.concatenate([c[:, None], bits * c[:, None]], axis=1)
            for d in range(depth):
                at = b.column(1 + d).to_numpy()[first]
                order = np.argsort(at, kind="stable")
                hit, start = np.unique(at[order], return_index=True)
                counters[d, hit] += np.add.reduceat(block[order], start, axis=0)
        d, at = np.nonzero(counters[:, :, 0])
        rows = counters[d, at]
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(at.astype(np.int32)), *(pa.array(rows[:, k]) for k in range(1 + BITS))], ["d", "at", *(f"c{k}" for k in range(1 + BITS))])

    named = [f"c{k}" for k in range(1 + BITS)]
    buckets = [_bucket(F.col("item"), d, width).alias(f"b{d}") for d in range(depth)]
    rows = df.select(F.col(item).cast("bigint").alias("item")).where("item is not null").select("item", *buckets)
    parts = rows.mapInArrow(count, "d int, at int, " + ", ".join(f"{c} bigint" for c in named))
    merged = parts.groupBy("d", "at").agg(*[F.sum(c).alias(c) for c in named]).toArrow()
    out = np.zeros((depth, width, 1 + BITS), np.int64)
    if merged.num_rows:
        out[merged.column("d").to_numpy(), merged.column("at").to_numpy()] = np.stack([merged.column(c).to_numpy() for c in named], axis=1)
    return out


def decode(counters: np.ndarray, threshold: float) -> np.ndarray:
    """Values spelled by the buckets that reach the threshold; at most depth / share of them."""
    d, at = np.nonzero(counters[:, :, 0] >= threshold)
    heavy = counters[d, at]
    bits = (2 * heavy[:, 1:] > heavy[:, :1]).astype(np.uint64)
    return np.unique((bits << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64))


def least_count(total: int, share: float) -> int:
    """The smallest count that is at least ``share`` of ``total``; the share is taken as the decimal number it is written as."""
    return max(1, math.ceil(total * Fraction(repr(share))))


def frequent(df: DataFrame, item: str, share: float, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(item, n_rows, estimate): every value with at least ``share`` of the rows that have one, its count, and the sketch's estimate (never below the count).

    Nulls don't count. An empty table, or one of nulls alone, gives no rows. Values are BIGINT; hash others first. At most depth × width candidates come
    to the driver, whatever the share; values that the sketch can't rule out are counted as a table."""
    if not 0 < share <= 1:
        raise ValueError("share lies between 0 and 1")
    spark = df.sparkSession
    counters = sketch(df, item, depth, width)
    total = int(counters[0, :, 0].sum())
    need = least_count(total, share)
    candidates = decode(counters, need) if total else np.zeros(0, np.int64)
    values = df.select(F.col(item).cast("bigint").alias("item")).where("item is not null")
    buckets = [_bucket(F.col("item"), d, width) for d in range(depth)]
    estimate = F.least(*[F.get(F.lit(counters[d, :, 0].tolist()), b) for d, b in enumerate(buckets)])

    def counted(found: DataFrame) -> DataFrame:
        return found.groupBy("item").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= need)

    listed = spark.createDataFrame([(int(c),) for c in candidates], "item bigint")
    heavy = counted(values.join(F.broadcast(listed), "item", "left_semi")).select("item", "n_rows", *[b.alias(f"b{d}") for d, b in enumerate(buckets)]).collect()  # of the candidates
    rest = counters[:, :, 0].copy()
    for r in heavy:
        for d in range(depth):
            rest[d, r[f"b{d}"]] -= r.n_rows
    found = spark.createDataFrame([(r.item, r.n_rows) for r in heavy], "item bigint, n_rows bigint")
    suspect = [np.flatnonzero(rest[d] >= need).tolist() for d in range(depth)]
    if total and all(suspect):
        within = F.lit(True)
        for d in range(depth):
            within = within & buckets[d].isin(suspect[d])
        missed = counted(values.where(within).join(F.broadcast(found.select("item")), "item", "left_anti"))
        found = found.unionByName(missed)
    return found.select(F.col("item").alias(item), "n_rows", estimate.cast("bigint").alias("estimate"))
