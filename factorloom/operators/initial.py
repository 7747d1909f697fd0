"""Starting vectors of items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import lists, seeded_normals


def initial_ids(items: DataFrame, previous: DataFrame | None) -> DataFrame:
    """(id, features): every current item, with its vector of the last generation if it has one, and every row of that generation without current data."""
    now = items.select(F.col("item_id").alias("id")).where("id is not null").distinct()
    if previous is None:
        return now.withColumn("features", F.lit(None).cast("array<float>"))
    return now.join(previous.select("id", "features"), "id", "full")


def initial_y(items: DataFrame, previous: DataFrame | None, k: int, seed: int = 1) -> DataFrame:
    """(id, features) of length k: as it was, cut and normalised, padded with gaussians and normalised, or a random unit vector.

    Random numbers depend on the id and the seed only. A previous vector that is null or empty counts as none."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            out = seeded_normals(ids, k, seed)
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            for i, v in enumerate(b.column(1)):
                v = v.values
                if v is None or not len(v):
                    continue
                old = v.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(old) == k:
                    out[i] = old
                    continue
                row = old[:k] if len(old) > k else np.concatenate([old, seeded_normals(ids[i : i + 1], k, seed + 1)[0, len(old) :]])
                out[i] = row / (np.linalg.norm(row) or 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(out.astype(np.float32))], ["id", "features"])

    return initial_ids(items, previous).select("id", "features").mapInArrow(fill, "id bigint, features array<float>")
