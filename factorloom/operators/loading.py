"""Published models, as the serving side loads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_partition(x: DataFrame, part: int | None, parts: int, tags: DataFrame | None = None) -> DataFrame:
    """The rows of a model of one serving partition (floor-mod of the id), without those of ``tags`` (id); all of them without partitions."""
    rows = x if part is None or parts <= 1 else x.where(F.pmod(F.col("id"), F.lit(parts)) == part)
    return rows if tags is None else rows.join(tags.select("id"), "id", "left_anti")


def clusters(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster, members, centroid): sorted members with their centroid; centroids without members are dropped, members without centroid are an error."""
    grouped = members.groupBy("cluster").agg(F.sort_array(F.collect_set("id")).alias("members"))
    joined = grouped.join(centroids.select("cluster", "centroid"), "cluster", "left")
    key = F.when(F.col("centroid").isNull(), F.raise_error(F.concat(F.lit("no centroid for cluster "), F.col("cluster").cast("string"))).cast("int")).otherwise(F.col("cluster"))
    return joined.select(key.alias("cluster"), "members", "centroid")


def prune(current: DataFrame, new_ids: DataFrame, recent_ids: DataFrame) -> DataFrame:
    """Rows of the model in memory that the new one has too, or that were active of late."""
    return current.join(new_ids.select("id").unionByName(recent_ids.select("id")).distinct(), "id", "left_semi")
