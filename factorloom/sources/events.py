"""Delimited preference lines and the other text inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import parse_vector, tag_id

# The text forms of an id and of a value.
ID = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BLANKS = " \t\r"
FLOAT_MAX = 3.4028235677973366e38  # half-way to the next power of two: rounds to infinity from here on


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def parse_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """``user,item[,value[,…]]`` to typed columns, beside the columns of ``df``.

    Adds user_id, item_id, pref_value (null for a delete), is_delete, user_is_tag, item_is_tag, is_bad. Null, empty and ``#`` lines are left out
    (tested before trimming). A field that starts with a double quote is a tag, its first and last character are dropped and the rest is hashed.
    The value is 1 when absent and a delete when empty. Both sides tags, fewer than two fields, or text that isn't a number: is_bad, other columns null.
    """
    line = F.col(column)
    kept = df.where(line.isNotNull() & (line != "") & ~line.startswith("#"))
    f = F.transform(F.split(line, ",", -1), _trim)
    user, item, value = F.get(f, 0), F.get(f, 1), F.get(f, 2)
    u_tag, i_tag = user.startswith('"'), item.startswith('"')

    def strip(c: Column) -> Column:
        return F.substring(c, F.lit(2), F.length(c) - 2)

    def ident(c: Column, tag: Column) -> Column:
        return F.when(tag & (F.length(c) > 1), tag_id(strip(c))).when(~tag & c.rlike(ID), F.regexp_replace(c, r"^\+", "").try_cast("bigint"))

    number = F.when(value.rlike(NUMBER), value.try_cast("double"))
    finite = F.when(F.abs(number) < FLOAT_MAX, number).cast("float")
    out = kept.withColumns({"_u": ident(user, u_tag), "_i": ident(item, i_tag), "_ut": u_tag, "_it": F.coalesce(i_tag, F.lit(False)), "_d": F.coalesce(value == "", F.lit(False)), "_v": F.when(F.size(f) < 3, F.lit(1.0).cast("float")).otherwise(finite)})
    bad = F.col("_u").isNull() | F.col("_i").isNull() | (F.col("_ut") & F.col("_it")) | (F.col("_v").isNull() & ~F.col("_d"))
    good = ~F.col("is_bad")
    return out.withColumn("is_bad", bad).select(
        *df.columns,
        F.when(good, F.col("_u")).alias("user_id"),
        F.when(good, F.col("_i")).alias("item_id"),
        F.when(good & ~F.col("_d"), F.col("_v")).alias("pref_value"),
        (good & F.col("_d")).alias("is_delete"),
        (good & F.col("_ut")).alias("user_is_tag"),
        (good & F.col("_it")).alias("item_is_tag"),
        "is_bad",
    )


def check_budget(parsed: DataFrame, budget: int) -> int:
    """The number of bad lines; raises when it exceeds the budget (of the whole input, not of a task)."""
    bad = parsed.where("is_bad").count()
    if bad > budget:
        raise ValueError(f"{bad} lines can't be read; at most {budget} may fail")
    return bad


def tags(parsed: DataFrame) -> DataFrame:
    """(kind, id): ids of quoted user fields are item tags, those of quoted item fields are user tags. Deletes count too."""
    items = parsed.where("user_is_tag").select(F.lit("item").alias("kind"), F.col("user_id").alias("id"))
    users = parsed.where("item_is_tag").select(F.lit("user").alias("kind"), F.col("item_id").alias("id"))
    return items.unionByName(users).distinct()


def event_lines(df: DataFrame) -> DataFrame:
    """The lines an append, tag or remove call writes: columns user_text, item_text, value (null: delete) become ``value STRING``; other columns stay."""
    line = F.concat(F.col("user_text"), F.lit(","), F.col("item_text"), F.lit(","), F.coalesce(F.col("value").cast("string"), F.lit("")))
    return df.withColumn("value", line).drop("user_text", "item_text")


def read_inbound(spark: SparkSession, path: str, form: str | None = None, **options: str) -> DataFrame:
    """Inbound records of a generation: text in any Hadoop codec, or any other source that yields ``value STRING``."""
    return spark.read.format(form or "text").options(**options).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parse_factors(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id<TAB>f,f,…`` to (id, features). Raises on a line without a tab or with text that is no number."""
    parts = F.split(F.col(column), "\t", 2)
    ident, vector = F.get(parts, 0).try_cast("bigint"), parse_vector(F.get(parts, 1))
    bad = ident.isNull() | vector.isNull() | F.exists(vector, lambda x: x.isNull())
    return lines.select(F.when(bad, F.raise_error(F.concat(F.lit("not a factor line: "), F.col(column))).cast("bigint")).otherwise(ident).alias("id"), vector.alias("features"))


def parse_known(lines: DataFrame, column: str = "value", separator: str = "\t") -> DataFrame:
    """``user<separator>i,i,…`` to (user_id, items)."""
    parts = F.split(F.col(column), rf"\Q{separator}\E", 2)
    return lines.select(F.get(parts, 0).cast("bigint").alias("user_id"), F.transform(F.split(F.get(parts, 1), ","), lambda x: x.cast("bigint")).alias("items"))


def read_tag_ids(spark: SparkSession, path: str) -> DataFrame:
    """Tag ids, one a line; a missing path is an empty set."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id bigint")
    return spark.read.text(path).select(F.col("value").cast("bigint").alias("id")).distinct()
