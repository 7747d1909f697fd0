"""Loading delimited lines while setting aside, with the reason, those that can't be read.

Records are assembled quote-aware where they may span lines. The strict csv reader takes each record; its exceptions are caught before any field is given a
type and are mapped to the reason.
"""

from __future__ import annotations

import csv
import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The forms of ids and values, and what is trimmed.
ID = re.compile(r"[+-]?[0-9]+")
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
BLANKS = " \t\r"
FLOAT_MAX = 3.4028235677973366e38
NEWLINE = "new-line character seen in unquoted field - do you need to open the file with newline=''?"  # the reader's message
LOW, HIGH = -(1 << 63), (1 << 63) - 1
OUT = "reason string, user_id bigint, user_tag string, item_id bigint, item_tag string, value double, is_delete boolean"


class Reject(ValueError):
    """A line that breaks a rule; its text is the name of the rule."""


def strict(text: str) -> list[str]:
    """The fields of one record by the strict csv reader. Broken quoting, and a line end within the record, are ``csv.Error``."""
    if "\n" in text:
        raise csv.Error("line feed within a record")
    return next(csv.reader([text], strict=True))


def lone(field: str) -> tuple[str, bool]:
    """(text, whether it was quoted) of a trimmed field that is read as a record of its own."""
    if '"' not in field:
        return field, False
    if not field.startswith('"'):
        raise csv.Error("quote within an unquoted field")
    (text,) = next(csv.reader([field], strict=True))
    if not text or '"' in text:
        raise csv.Error("nothing, or a doubled quote, between quotes")
    return text, True


def structure(line: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """(fields, (text, quoted) of user and item) of a line; Reject for a broken structure.

    The strict reader takes the line as a whole. What it gives stands if it has as many fields as the line has commas, for here every comma separates, also
    within quotes. An exception of the reader, or a comma that it took for text, says that something is broken, not where: user and item are then read
    alone, and the exception of one of them is a broken quoting. A break in the value or the note is none of the structure."""
    plain = line.split(",")
    try:
        read = strict(line)
        whole = len(read) == len(plain)
    except csv.Error:
        whole = False
    if not 2 <= len(plain) <= 4:
        raise Reject("column_count")
    fields = [f.strip(BLANKS) for f in plain]
    if whole and '"' not in line:
        return fields, [(f, False) for f in fields[:2]]
    try:
        return fields, [lone(f) for f in fields[:2]]
    except csv.Error as e:
        raise Reject("quoting") from e


def ident(field: str, rule: str) -> int:
    digits = field.lstrip("+-").lstrip("0") or "0"
    if not ID.fullmatch(field) or len(digits) > 19 or not LOW <= (n := int(digits) * (-1 if field[0] == "-" else 1)) <= HIGH:
        raise Reject(rule)
    return n


def value(field: str) -> float | None:
    """None for an empty field: a delete."""
    if field == "":
        return None
    if not NUMBER.fullmatch(field) or not abs(x := float(field)) < FLOAT_MAX:
        raise Reject("value")
    return x


def record(line: str) -> tuple:
    """The typed fields of a line. Structural exceptions come before the constructors of the fields."""
    fields, ((user, user_tag), (item, item_tag)) = structure(line)
    if user_tag and item_tag:
        raise Reject("both_tags")
    u = None if user_tag else ident(user, "user_id")
    i = None if item_tag else ident(item, "item_id")
    v = value(fields[2]) if len(fields) > 2 else 1.0
    return None, u, user if user_tag else None, i, item if item_tag else None, v, v is None


def read_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason, user_id, user_tag, item_id, item_tag, value, is_delete): one row for each line that counts; reason is null for a line that is loaded.

    Null and empty lines and comments (first character ``#``) are left out. The reason is the first rule broken, of column_count, quoting, both_tags,
    user_id, item_id, value. Other columns of ``df`` don't matter, whatever their names. An empty table gives an empty one."""
    kind = df.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
        for b in batches:
            rows = []
            csv.field_size_limit(sys.maxsize)
            for line in b.column(1).to_pylist():
                try:
                    rows.append(record(line))
                except Reject as e:
                    rows.append((str(e), None, None, None, None, None, None))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["key", "reason", "user_id", "user_tag", "item_id", "item_tag", "value", "is_delete"])

    lines = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and text != '' and not startswith(text, '#')")
    return lines.mapInArrow(parse, f"key {kind}, {OUT}").withColumnRenamed("key", key)


def _lines(df: DataFrame, file: str, order: str, text: str, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(lines of records of at most ``most`` lines, lines of longer records): file _f, first line _r, block _b, order _o and text _t of every line; those of
    longer records with the number _n of the record's lines and _cr, whether it has a carriage return.

    Whether a line begins inside quotes is the parity of the quotes before it in its file. It is counted in two levels, so that no task gets a whole
    file: parities of blocks of ``block`` numbers first (order numbers lines), then of the lines of a block."""
    quotes = F.length(F.col("_t")) - F.length(F.replace(F.col("_t"), F.lit('"')))
    rows = df.select(F.struct(F.col(file).alias("v")).alias("_f"), F.col(order).cast("bigint").alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumns({"_b": F.floor(F.col("_o") / block), "_q": quotes})
    blocks = rows.groupBy("_f", "_b").agg(F.sum("_q").alias("_n"))
    before = W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("_f", "_b").orderBy("_o").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_p"))
    lines = rows.join(starts, ["_f", "_b"]).withColumn("_open", (F.col("_p") + F.coalesce(F.sum("_q").over(inside), F.lit(0))) % 2 == 1)
    first = lines.groupBy("_f", "_b").agg(F.max(F.when(~F.col("_open"), F.col("_o"))).alias("_last"))
    carried = first.select("_f", "_b", F.last("_last", True).over(before).alias("_carry"))
    here = W.partitionBy("_f", "_b").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    named = lines.join(carried, ["_f", "_b"]).withColumn("_r", F.coalesce(F.last(F.when(~F.col("_open"), F.col("_o")), True).over(here), F.col("_carry")))
    sizes = named.groupBy("_f", "_r").agg(F.count("*").alias("_n"), F.max(F.col("_t").contains("\r")).alias("_cr"))
    long = sizes.where(F.col("_n") > max(most, 1))
    columns = ["_f", "_r", "_b", "_o", "_t"]
    return named.join(long.select("_f", "_r"), ["_f", "_r"], "left_anti").select(*columns), named.join(long, ["_f", "_r"]).select(*columns, "_n", "_cr")


def _text(order: str):
    """The texts of a group, by their order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "\n")


def _short(lines: DataFrame) -> DataFrame:
    return lines.groupBy("_f", "_r").agg(F.count("*").alias("_n"), _text("_o").alias("_l"))


def assemble(df: DataFrame, file: str, order: str, text: str, block: int = 4096, most: int = 10_000) -> DataFrame:
    """(file, order, n_lines, text): physical lines joined to records, a record going on while a quote is open; order is that of its first line.

    A quote that never closes ends with its file. Null lines count as empty, lines of a null file as those of one file. Every record has its whole text; one
    of more than ``most`` lines is joined by blocks first. As one value it is bounded by what a string may hold (2 GB): ``digests`` and ``read_records``
    need no such value.
    """
    short, long = _lines(df, file, order, text, block, most)
    pieces = long.groupBy("_f", "_r", "_n", "_b").agg(_text("_o").alias("_t"))
    out = _short(short).unionByName(pieces.groupBy("_f", "_r", "_n").agg(_text("_b").alias("_l")))
    return out.select(F.col("_f.v").alias(file), F.col("_r").alias(order), F.col("_n").alias("n_lines"), F.col("_l").alias(text))


def digests(df: DataFrame, file: str, order: str, text: str, block: int = 4096, most: int = 10_000) -> DataFrame:
    """(file, order, n_lines, record): the records of ``assemble`` with the MD5 of their text. Lines of a record of more than ``most`` lines are
    sorted and pass one after another, so that it is never held as a whole."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, md5 = None, None
        for b in batches:
            done = []
            for f, r, n, t in zip(*(c.to_pylist() for c in b.columns[:4])):
                if (f, r, n) != key:
                    done += [(*key, md5.hexdigest())] if key else []
                    key, md5 = (f, r, n), hashlib.md5()
                else:
                    md5.update(b"\n")
                md5.update(t.encode())
            types = [*b.schema.types[:3], pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 4, types)], names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, md5.hexdigest()), types)], names)

    names = ["_f", "_r", "_n", "_l"]
    short, long = _lines(df, file, order, text, block, most)
    kind = df.schema[file].dataType.simpleString()
    passed = long.select("_f", "_r", "_n", "_t", "_o").repartition("_f", "_r").sortWithinPartitions("_f", "_r", "_o").mapInArrow(digest, f"_f struct<v:{kind}>, _r bigint, _n bigint, _l string")
    out = _short(short).withColumn("_l", F.md5(F.col("_l").cast("binary"))).unionByName(passed)
    return out.select(F.col("_f.v").alias(file), F.col("_r").alias(order), F.col("_n").alias("n_lines"), F.col("_l").alias("record"))


def line_part(line: str, first: bool, single: bool) -> tuple[int, bool, str | None]:
    """(fields, whether the record ends here, the reader's message) of one line of a record: of the first line, or of one that begins inside quotes.

    A quote is put before the latter. One more after the line is read only where the line leaves its quotes open; the field that goes on in the next line
    is counted. ``single``: the reader is given the record in one, not by its line ends."""
    if not first:
        if '"' not in line:
            return 1, False, None
        line = '"' + line
    given = [line] if single else line.splitlines(keepends=True)
    reader = csv.reader([*given, '"'], strict=True)
    try:
        fields = len(next(reader))
    except csv.Error as e:
        return 0, False, str(e)
    return fields, reader.line_num <= len(given), None


def _fold(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The parts (_k fields, _e ended, _x error, _w may follow an end) of a group, by their order, taken together as one part.

    A field open at the end of a part is the first of the next, and counts once. What follows an end or an error isn't read, but what may not follow an end is an error."""

    def add(a, x):
        stopped = a["_e"] | a["_x"].isNotNull()
        error = F.when(a["_x"].isNotNull(), a["_x"]).when(a["_e"], F.when(~x["_w"], F.lit(NEWLINE))).otherwise(x["_x"])
        return F.struct(F.when(stopped, a["_k"]).otherwise(a["_k"] + x["_k"] - 1).alias("_k"), F.when(stopped, a["_e"]).otherwise(x["_e"]).alias("_e"), error.alias("_x"), (a["_w"] & x["_w"]).alias("_w"))

    none = F.struct(F.lit(1).cast("bigint").alias("_k"), F.lit(False).alias("_e"), F.lit(None).cast("string").alias("_x"), F.lit(True).alias("_w"))
    parts = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "_k", "_e", "_x", "_w"))).alias("_p"))
    return parts.select(*keys, F.aggregate("_p", none, add).alias("_p")).select(*keys, "_p.*")


def read_records(df: DataFrame, file: str, order: str, text: str, most: int = 10_000) -> DataFrame:
    """(file, order, n_lines, n_fields, error): every record of files whose quotes may span lines, by the strict csv reader; n_fields is null and error the reader's message where it fails.

    Empty records (blank lines) are left out. A record of more than ``most`` lines is not gathered: the reader takes its lines one by one, as each but the first
    begins inside quotes as long as the record lasts, and what it gives is added up by blocks, then by records. The result is that of the whole text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            counts, errors = [], []
            for t in b.column(3).to_pylist():
                try:
                    counts.append(len(next(csv.reader(t.splitlines(keepends=True) if "\r" not in t else [t], strict=True))))
                    errors.append(None)
                except csv.Error as e:
                    counts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(counts, pa.int32()), pa.array(errors, pa.string())], [*b.schema.names[:3], "_k", "_x"])

    def parse_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            _, record, _, _, number, texts, single = (c.to_pylist() for c in b.columns)
            parts = [(*line_part(t, o == r, cr), not cr or not t.strip("\r\n")) for r, o, t, cr in zip(record, number, texts, single)]
            columns = list(zip(*parts)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.bool_(), pa.string(), pa.bool_()]))], [*b.schema.names[:5], "_k", "_e", "_x", "_w"])

    short, long = _lines(df, file, order, text, 4096, most)
    kind = f"_f struct<v:{df.schema[file].dataType.simpleString()}>, _r bigint, _n bigint"
    gathered = _short(short).where("_l != ''").mapInArrow(parse, f"{kind}, _k int, _x string")
    told = long.where(F.col("_t").contains('"') | F.col("_cr"))  # any other line leaves its quotes open and may follow an end; first lines have a quote
    parts = told.select("_f", "_r", "_n", "_b", "_o", "_t", "_cr").mapInArrow(parse_lines, f"{kind}, _b bigint, _o bigint, _k bigint, _e boolean, _x string, _w boolean")
    passed = _fold(_fold(parts, ["_f", "_r", "_n", "_b"], "_o"), ["_f", "_r", "_n"], "_b")
    passed = passed.withColumn("_x", F.when(F.col("_x").isNull() & ~F.col("_e"), "unexpected end of data").otherwise(F.col("_x")))
    passed = passed.withColumn("_k", F.when(F.col("_x").isNull(), F.col("_k")).cast("int")).select("_f", "_r", "_n", "_k", "_x")
    return gathered.unionByName(passed).select(F.col("_f.v").alias(file), F.col("_r").alias(order), F.col("_n").alias("n_lines"), F.col("_k").alias("n_fields"), F.col("_x").alias("error"))
