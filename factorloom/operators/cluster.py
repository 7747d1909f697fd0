"""Spherical k-means over factor vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import lists, matrix


def _plus_plus(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Indices of k seeds, each drawn by its distance max(0, 1 - cos) to those before; at random if all distances are 0."""
    with np.errstate(all="ignore"):
        u = np.nan_to_num(v / np.linalg.norm(v, axis=1, keepdims=True))
    picked = [int(rng.integers(len(u)))]
    far = np.maximum(0, 1 - u @ u[picked[0]])
    while len(picked) < k:
        total = far.sum()
        nxt = int(rng.integers(len(u))) if total <= 0 else min(int(np.searchsorted(np.cumsum(far), rng.random() * total)), len(u) - 1)
        picked.append(nxt)
        far = np.minimum(far, np.maximum(0, 1 - u @ u[nxt]))
    return np.array(picked)


def seeds(factors: DataFrame, k: int, tags: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(cluster, centroid): k-means++ over all vectors of each partition, which a task holds in memory, and again over the candidates. At most 4k + partitions candidates come to the driver. No rows for no vectors."""
    rows = factors.where("features is not null").select("id", "features")
    if tags is not None:
        rows = rows.join(tags.select("id"), "id", "left_anti")
    spark = factors.sparkSession
    splits = max(1, rows.rdd.getNumPartitions())
    each = k if splits <= 4 else max(1, 4 * k // splits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [matrix(b.column(1)) for b in batches if b.num_rows]
        kept = np.concatenate(held) if held else None
        held.clear()
        rng = np.random.default_rng(seed)
        if kept is not None:
            chosen = kept[_plus_plus(kept, min(each, len(kept)), rng)]
            yield pa.RecordBatch.from_arrays([lists(chosen)], ["centroid"])

    found = rows.mapInArrow(pick, "centroid array<double>").toArrow()
    if not found.num_rows:
        return spark.createDataFrame([], "cluster int, centroid array<double>")
    m = matrix(found.column(0))
    m = m[np.lexsort(m.T)]
    chosen = m[_plus_plus(m, k, np.random.default_rng(seed))]
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(chosen)], "cluster int, centroid array<double>")


def _nearest(factors: DataFrame, centroids: DataFrame, tags: DataFrame | None, digits: int | None, emit: Callable, schema: str) -> DataFrame:
    """``emit(batches of (ids, vectors, names of the nearest clusters))`` over all rows with a finite cosine."""
    rows = factors.where("features is not null").select("id", "features")
    if tags is not None:
        rows = rows.join(tags.select("id"), "id", "left_anti")
    local = centroids.select("cluster", F.col("centroid").cast("array<double>").alias("centroid")).orderBy("cluster").toArrow()
    if not local.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    names, c = local.column(0).to_numpy().astype(np.int32), matrix(local.column(1))  # k rows, k being a setting
    with np.errstate(all="ignore"):
        c = c / np.linalg.norm(c, axis=1, keepdims=True)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(1))
            with np.errstate(all="ignore"):
                cos = v @ c.T / np.linalg.norm(v, axis=1, keepdims=True)
                cos = np.where(np.isfinite(cos), cos if digits is None else np.round(cos, digits), -np.inf)
            ok = np.isfinite(cos).any(axis=1)
            yield b.column(0).filter(pa.array(ok)), v[ok], names[cos.argmax(axis=1)[ok]]

    return rows.mapInArrow(lambda batches: emit(nearest(batches)), schema)


def assign(factors: DataFrame, centroids: DataFrame, tags: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(id, cluster) of highest cosine, ties to the smaller cluster; vectors without a finite cosine are left out. Centroids are k rows, k being a setting."""

    def emit(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for ids, _, best in found:
            yield pa.RecordBatch.from_arrays([ids, pa.array(best)], ["id", "cluster"])

    return _nearest(factors, centroids, tags, digits, emit, "id bigint, cluster int")


def adjust(factors: DataFrame, centroids: DataFrame, tags: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(cluster, weight, centroid): number and sum of the vectors that are nearest to each centroid. Clusters without members vanish.

    Vectors are added where they are assigned; a task gives one row a cluster and element."""

    def emit(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, v, best in found:
            for name in np.unique(best).tolist():
                mine = v[best == name]
                sums[name] = sums.get(name, 0) + np.append(mine.sum(axis=0), len(mine))
        for name, total in sums.items():
            k = len(total) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, name, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(total[:k]), pa.array(np.full(k, int(total[k])))], ["cluster", "pos", "v", "n"])

    parts = _nearest(factors, centroids, tags, digits, emit, "cluster int, pos int, v double, n bigint")
    sums = parts.groupBy("cluster", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = F.sort_array(F.collect_list(F.struct("pos", "v")))
    return sums.groupBy("cluster").agg(F.max("n").alias("weight"), F.transform(whole, lambda x: x["v"]).alias("centroid"))


def kmeans(factors: DataFrame, k: int, iterations: int, keep, tags: DataFrame | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(clusters, centroids) after the given number of assign-and-adjust rounds; nothing happens in the first iteration of a run, seeds are drawn in the second."""
    centroids = keep(seeds(factors, k, tags, seed), "c-0")
    for n in range(1, iterations + 1):
        centroids = keep(adjust(factors, centroids, tags).select("cluster", "centroid"), f"c-{n}")
    return assign(factors, centroids, tags), centroids
