"""Rows and columns of the preference matrix, known items, and the ids a partition needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(prefs: DataFrame, by: str, of: str) -> DataFrame:
    """(by, entries): the sorted (of, value) entries of each row of the matrix. The list of one id is the result asked for; nothing else is gathered."""
    return prefs.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(of), F.col("value")))).alias("entries"))


def user_vectors(prefs: DataFrame) -> DataFrame:
    return vectors(prefs, "user_id", "item_id")


def item_vectors(prefs: DataFrame) -> DataFrame:
    return vectors(prefs, "item_id", "user_id")


def known_items(prefs: DataFrame) -> DataFrame:
    """(user_id, items): sorted distinct items of each user; tags stay in."""
    return prefs.groupBy("user_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def ids_by_partition(prefs: DataFrame, by: str, of: str, n: int) -> DataFrame:
    """(part, of): the distinct ids that the rows of each of n partitions refer to; part = floor-mod of the row's id."""
    return prefs.select(F.pmod(F.col(by), F.lit(n)).cast("int").alias("part"), of).distinct()
