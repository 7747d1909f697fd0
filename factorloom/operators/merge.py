"""Folding a batch of preference deltas into the preferences of the previous generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ("user_id", "item_id")


def sum_new(deltas: DataFrame) -> DataFrame:
    """(user_id, item_id, new_value, deleted) of deltas with pref_value and is_delete. Sums are in double; pairs with a null id don't count."""
    known = deltas.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    value = F.when(~F.coalesce(F.col("is_delete"), F.lit(False)), F.col("pref_value").cast("double"))
    return known.groupBy(*PAIR).agg(F.sum(value).alias("new_value"), F.max(F.coalesce(F.col("is_delete"), F.lit(False))).alias("deleted"))


def merge_old_new(old: DataFrame | None, deltas: DataFrame, decay: float = 1.0, zero_threshold: float = 0.0) -> DataFrame:
    """(user_id, item_id, value): old values, decayed, plus the sum of new ones.

    A pair of old with any delete in the batch is dropped, even if the batch has values for it too; a delete of a pair that isn't in old has no effect.
    Results with abs(value) <= zero_threshold are dropped. Empty inputs on either side are fine.
    """
    if zero_threshold < 0:
        raise ValueError("the zero threshold is at least 0")
    new = sum_new(deltas)
    if old is None:
        merged = new.select(*PAIR, F.col("new_value").alias("value"))
    else:
        before = old.groupBy(*PAIR).agg((F.sum(F.col("value").cast("double")) * F.lit(float(decay))).alias("old_value"))
        joined = before.join(new, [*PAIR], "full")
        gone = F.col("old_value").isNotNull() & F.coalesce(F.col("deleted"), F.lit(False))
        value = F.when(F.col("old_value").isNotNull(), F.col("old_value") + F.coalesce("new_value", F.lit(0.0))).otherwise(F.col("new_value"))
        merged = joined.where(~gone).select(*PAIR, value.alias("value"))
    return merged.where(F.col("value").isNotNull() & (F.abs("value") > zero_threshold))


def merge_tags(new: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Distinct ids of this generation's tags and those of the one before."""
    ids = new.select("id") if previous is None else new.select("id").unionByName(previous.select("id"))
    return ids.where("id is not null").distinct()
