"""Current usable vectors of a table of factor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import usable

LENGTH = 50


def usable_rows(df: DataFrame, key: str, k: int = LENGTH) -> DataFrame:
    """(id, features) of all rows with a usable vector, older ones too: for statistics that need no shuffle."""
    return df.where(F.col(key).isNotNull() & usable(F.col("features"), k)).select(F.col(key).alias("id"), "features")


def current(df: DataFrame, key: str, k: int = LENGTH) -> DataFrame:
    """(id, features): of each id the vector of its greatest generation, if that is usable: k finite elements, not all null or zero.

    Older rows of an id never stand in for an unusable current one. Rows with a null id are left out. Partial maxima are taken before the shuffle, so that an
    id with very many rows is no burden."""
    good = F.when(usable(F.col("features"), k), F.col("features"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "generation_id", F.struct(good.alias("f")).alias("v"))
    newest = rows.groupBy("id").agg(F.max_by("v", F.coalesce("generation_id", F.lit(-(1 << 63)))).alias("v"))
    return newest.select("id", F.col("v.f").alias("features")).where("features is not null")
