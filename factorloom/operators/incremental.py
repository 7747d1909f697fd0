"""Processing only what is new or changed.

A table is looked at by partitions (any key columns). Of each partition a fingerprint is taken: the number of its rows and the sum of their hashes,
which doesn't depend on order and is built by partial sums. Partitions whose fingerprint differs from the one of the last successful run are
recomputed as a whole and replaced by dynamic partition overwrite; the new fingerprints are written last. A run that fails at any point leaves the old
fingerprints in force, so the next one recomputes the same partitions and nothing is skipped or taken twice.

What a run has to take of versioned writes is found the same way: successful runs leave the fingerprints of what they saw and, for each partition, the
greatest revision taken of each write. The next run reads the rows of changed partitions only, and compares their revisions with the stored ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_path, write_table
from ..sources.store import Store

#: Rows of a table of partitions up to which it is sent to all executors (some 64 bytes each).
SMALL_ROWS = 200_000
#: Partitions up to which they are named in a filter, which prunes files and row groups; more are joined.
NAMED = 2_000
#: Rows of a file of a derived table.
FILE_ROWS = 5_000_000
HASH = "decimal(20,0)"


def row_hash(columns: list[str]) -> Column:
    """64 bits of a row; nulls count by their place, so (null, 1) and (1, null) differ."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))]).cast(HASH)


def fingerprints(df: DataFrame, keys: list[str], columns: list[str], seen: Column | None = None) -> DataFrame:
    """(keys, n_rows, row_sum) of each partition; with ``seen``, also (n_seen, seen_sum) over the rows for which it holds. No rows for an empty table."""
    aggs = [F.count("*").alias("n_rows"), F.sum(row_hash(columns)).alias("row_sum")]
    if seen is not None:
        is_seen = F.coalesce(seen, F.lit(False))
        aggs += [F.count(F.when(is_seen, 1)).alias("n_seen"), F.sum(F.when(is_seen, row_hash(columns))).alias("seen_sum")]
    return df.groupBy(*keys).agg(*aggs)


def attach(df: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` joined with a table of partitions; that one is sent to all executors only if a count shows that it is small. Null keys match null keys."""
    small = parts.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    right = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in parts.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(F.broadcast(right) if small else right, on).drop(*[f"_{k}" for k in keys])


def rows_of(df: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the given partitions. Up to NAMED of them are named in the filter, so that the files and row groups of others aren't read."""
    named = parts.select(*keys).limit(NAMED + 1).collect()
    if len(named) > NAMED:
        return attach(df, parts.select(*keys), keys)
    if not named:
        return df.limit(0)
    by: dict[tuple, list] = {}
    for r in named:
        by.setdefault(tuple(r[:-1]), []).append(r[-1])
    kinds = {k: df.schema[k].dataType for k in keys}
    equal = lambda k, v: F.col(k).isNull() if v is None else F.col(k) == F.lit(v).cast(kinds[k])
    wanted = F.lit(False)
    for head, last in by.items():
        some = [F.lit(v).cast(kinds[keys[-1]]) for v in last if v is not None]
        here = F.col(keys[-1]).isin(*some) if some else F.lit(False)
        if None in last:
            here = here | F.col(keys[-1]).isNull()
        for k, v in zip(keys, head):
            here = equal(k, v) & here
        wanted = wanted | here
    return df.where(wanted)


def plain_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as they come back from the names of folders, where an empty text and null are the same."""
    texts = [k for k in keys if isinstance(df.schema[k].dataType, T.StringType)]
    return df.withColumns({k: F.when(F.col(k) != "", F.col(k)) for k in texts}) if texts else df


def versions(store: Store, state: str) -> list[int]:
    return [int(v) for v in store.list(state) if v.isdigit() and store.exists(f"{state}/{v}/_SUCCESS")]


def compare(now: DataFrame, state: str, keys: list[str]) -> DataFrame:
    """(keys, n_rows, gone): partitions that are not as the newest fingerprints below ``state`` have them; gone ones are there and not in ``now``. All of ``now`` where there are none."""
    spark = now.sparkSession
    there = versions(Store(spark), state)
    if not there:
        return now.select(*keys, "n_rows", F.lit(False).alias("gone"))
    old = spark.read.parquet(f"{state}/{max(there):010d}").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n_rows").alias("_n"), F.col("row_sum").alias("_s"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    same = F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("row_sum").eqNullSafe(F.col("_s"))
    gone = F.col("n_rows").isNull()
    return now.join(old, on, "full").where(~same).select(*[F.when(gone, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys], "n_rows", gone.alias("gone"))


def _folder(spark: SparkSession, keys: list[str], row) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if row[k] is None else escape(str(row[k]))}" for k in keys)


def refresh(source: DataFrame, keys: list[str], transform: Callable[[DataFrame], DataFrame], target: str, state: str) -> int:
    """Brings ``target`` (Parquet, partitioned by keys) up to date with ``source``; returns the number of partitions that were recomputed or removed.

    ``transform`` gets the rows of the changed partitions and keeps the key columns. Keys may be null; an empty text counts as null, as names of folders
    can't tell them apart. Partitions that left the source, and those of which ``transform`` gives nothing, are deleted. ``state`` holds one table of
    fingerprints a run; only complete ones count, and the newest is in force.
    """
    spark: SparkSession = source.sparkSession
    store = Store(spark)
    source = plain_keys(source, keys)
    there = versions(store, state)
    fresh = f"{state}/{max(there, default=0) + 1:010d}"
    now_path = f"{fresh}-pending"
    fingerprints(source, keys, sorted(source.columns)).write.mode("overwrite").parquet(now_path)
    now = spark.read.parquet(now_path)
    differ = write_table(compare(now, state, keys), "differ")
    changed, n = differ.where("not gone"), differ.count()
    if n:
        made = plain_keys(transform(rows_of(source, changed, keys)), keys)
        files = changed.select(*keys, F.ceil(F.col("n_rows") / FILE_ROWS).alias("_files"))
        piece = F.pmod(F.xxhash64(*[c for c in made.columns if c not in keys]), F.col("_files"))
        spread = attach(made, files, keys).withColumn("_piece", piece).repartition(*keys, "_piece").drop("_files", "_piece")
        done = write_table(spread.sortWithinPartitions(*keys), "refresh")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)
        kept = done.select(*keys).distinct().withColumn("_kept", F.lit(True))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        empty = differ.join(kept.select(*[F.col(k).alias(f"_{k}") for k in keys], "_kept"), on, "left").where("_kept is null").select(*keys)
        for row in empty.toLocalIterator():  # names of folders, one at a time
            store.delete(f"{target}/{_folder(spark, keys, row)}", recursive=True)
    store.delete(fresh, recursive=True)
    store.move(now_path, fresh)
    return n


def seen_until(partitions: DataFrame, runs: DataFrame) -> DataFrame:
    """(instance_id, generation_id, seen_until): of each partition, the start of the latest successful run of its instance that covers it; null if none does.

    A run with done_marker covers the generations after coalesce(last_generation_id, -1) up to its own. Rows of the log may come twice."""
    done = runs.where("done_marker").select(F.col("instance_id").alias("_i"), F.coalesce("last_generation_id", F.lit(-1)).alias("_from"), F.col("generation_id").alias("_to"), "started_at").distinct()
    covered = (F.col("instance_id") == F.col("_i")) & (F.col("generation_id") > F.col("_from")) & (F.col("generation_id") <= F.col("_to"))
    return partitions.join(done, covered, "left").groupBy("instance_id", "generation_id").agg(F.max("started_at").alias("seen_until"))


#: Partitions of deliveries of writes, and the columns whose change counts.
KEYS = ["instance_id", "generation_id"]
COLUMNS = ["rec_id", "write_id", "revision", *KEYS]


def taken(rows: DataFrame) -> DataFrame:
    """(instance_id, generation_id, write_id, revision): of each partition the greatest revision of each write."""
    return rows.groupBy(*KEYS, "write_id").agg(F.max("revision").alias("revision"))


def commit(rows: DataFrame, target: str, state: str) -> int:
    """After a successful run over ``rows`` (COLUMNS): stores what it took and the fingerprints. Returns the number of partitions that differed."""
    return refresh(rows.select(*COLUMNS), KEYS, taken, target, state)


def due(rows: DataFrame, target: str, state: str) -> DataFrame:
    """(instance_id, write_id, revision, rec_id) of the writes in ``rows`` (COLUMNS) with a revision greater than any that successful runs have taken, as ``commit`` has stored it.

    Of copies of a revision the smallest rec_id is taken. Rows of partitions whose fingerprint is the stored one aren't read."""
    spark = rows.sparkSession
    rows = plain_keys(rows.select(*COLUMNS), KEYS)
    now = fingerprints(rows, KEYS, sorted(COLUMNS))
    changed = write_table(compare(now, state, KEYS).where("not gone"), "changed")
    fresh = rows_of(rows, changed, KEYS)
    best = fresh.groupBy("instance_id", "write_id").agg(F.max(F.struct("revision", F.bitwise_not("rec_id").alias("r"))).alias("best"))  # of equal revisions the smallest rec_id
    if not Store(spark).exists(target):
        return best.select("instance_id", "write_id", "best.revision", F.bitwise_not("best.r").alias("rec_id"))
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("write_id", "revision", *KEYS)])
    had = spark.read.schema(schema).parquet(target).select(F.col("instance_id").alias("_i"), F.col("write_id").alias("_w"), F.col("revision").alias("_done"))
    same = F.col("instance_id").eqNullSafe(F.col("_i")) & (F.col("write_id") == F.col("_w"))
    done = best.select("instance_id", "write_id").join(had, same).groupBy("_i", "_w").agg(F.max("_done").alias("_done"))
    out = best.join(done, same, "left").where(F.col("_done").isNull() | (F.col("best.revision") > F.col("_done")))
    return out.select("instance_id", "write_id", F.col("best.revision").alias("revision"), F.bitwise_not("best.r").alias("rec_id"))


def pending_writes(deltas: DataFrame, runs: DataFrame, at: str | None = None) -> DataFrame:
    """(instance_id, write_id, revision, rec_id) of the writes a next run has to take: new ones, and those whose latest revision no successful run has seen.

    deltas: rec_id, write_id, revision, instance_id, generation_id, landed_at. The log of runs tells what the successful ones saw; that is committed first, below
    ``at`` (by default a folder of this call), as they would have done themselves. From then on only partitions that have changed since are read.
    """
    rows = deltas.select(*COLUMNS, "landed_at")
    at = at or work_path(rows.sparkSession, "runs")
    cover = write_table(seen_until(rows.select(*KEYS).distinct(), runs), "cover")
    seen = attach(rows, cover.where("seen_until is not null"), KEYS).where("landed_at <= seen_until")
    commit(seen, f"{at}/taken", f"{at}/state")
    return due(rows, f"{at}/taken", f"{at}/state")
