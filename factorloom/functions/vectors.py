"""Vector and id expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, v: s + v)


def norm(a: Column) -> Column:
    squares = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0).cast("double"), lambda s, v: s + v))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def usable(a: Column, k: int) -> Column:
    """True for vectors of k finite elements that aren't all zero; False, not null, for anything else."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(a) == k) & ~bad & F.exists(a, lambda x: x != 0), F.lit(False))


def tag_id(text: Column) -> Column:
    """64-bit id of a tag: the first eight bytes of the MD5 of its text, big-endian and signed."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("bigint")


def format_vector(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def parse_vector(text: Column, kind: str = "float") -> Column:
    return F.transform(F.split(text, ","), lambda x: x.try_cast(kind))


def resize(a: Column, k: int) -> Column:
    """Vectors of length k stay as they are; longer ones are cut to k and brought to norm 1. Shorter ones need padding (see initial_y)."""
    cut = F.slice(a, 1, k)
    return F.when(F.size(a) > k, normalized(cut)).otherwise(F.transform(a, lambda x: x.cast("double")))
