"""Published outputs: gzip text ``key<TAB>value``, or another sink of the user's choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import format_vector


def write_text(df: DataFrame, path: str, key: str, value: str | None = None, one_file: bool = False) -> None:
    """Writes lines; with one_file only for outputs of a bounded size (tags of a run, centroids)."""
    line = F.col(key).cast("string") if value is None else F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string"))
    out = df.select(line.alias("value"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("compression", "gzip").text(path)


def write_output(df: DataFrame, path: str, key: str, value: str, sink: tuple[str | None, str | None] = (None, None)) -> None:
    """Text under ``path``, or with a custom (format, path) there. Setting one of the two alone is an error."""
    form, target = sink
    if bool(form) != bool(target):
        raise ValueError("the format and the path of a sink are set together")
    if form:
        df.write.mode("overwrite").format(form).save(target)
    else:
        write_text(df, path, key, value)


def factor_lines(df: DataFrame, vector: str = "features") -> DataFrame:
    return df.withColumn("line", format_vector(F.col(vector)))


def format_pairs(recs: str, style: str = "brackets"):
    """``[id:value,…]``, or ``[[id,value],…]`` in style json, of an array of (id, value)."""
    if style == "json":
        body = F.transform(F.col(recs), lambda r: F.concat(F.lit("["), r["id"].cast("string"), F.lit(","), r["value"].cast("string"), F.lit("]")))
    else:
        body = F.transform(F.col(recs), lambda r: F.concat_ws(":", r["id"].cast("string"), r["value"].cast("string")))
    return F.concat(F.lit("["), F.array_join(body, ","), F.lit("]"))
