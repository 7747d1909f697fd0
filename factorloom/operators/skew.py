"""Per-key results and joins when a few keys hold most rows: fragment and replicate by load.

The load of every key is counted; keys above a fraction of what a task should get (a bounded number of them) are cut into shards in proportion to their
load; the other keys fall into buckets, some for each task, whose loads are summed. Shards and buckets are packed onto tasks, largest first, each next to
the least loaded one. Rows travel to the task of their shard or bucket, the matching side of a join only to the shards of its key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_table

#: A key is split when its load exceeds this part of a task's fair share; so at most tasks / SPLIT keys are split.
SPLIT = 0.25
#: Buckets of light keys for each task.
BUCKETS = 16


@dataclass
class Plan:
    tasks: int
    slots: list[int]  # slot number of each bucket of light keys: its hash leads to a task
    heavy: list[tuple]  # (key, slot numbers of its shards)
    total: int
    loads: list[float]  # planned load of each task

    def shards(self, spark: SparkSession, key: str, kind: str) -> DataFrame:
        """(key, slots) of the split keys: at most tasks / SPLIT rows."""
        return spark.createDataFrame(self.heavy or [], f"{key} {kind}, __slots array<int>")


def _slots(spark: SparkSession, tasks: int) -> list[int]:
    """For each task a number that hash partitioning sends there."""
    found: dict[int, int] = {}
    span = 32 * tasks
    start = 0
    while len(found) < tasks:
        for row in spark.range(start, start + span).select(F.col("id").cast("int").alias("s")).select("s", F.pmod(F.hash("s"), F.lit(tasks)).alias("t")).collect():
            found.setdefault(row.t, row.s)
        start += span
    return [found[t] for t in range(tasks)]


def _bucket(key: str, tasks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(BUCKETS * tasks)).cast("int")


def plan(loads: DataFrame, key: str, tasks: int) -> Plan:
    """loads: (key, load) of every key, without null keys. Only the split keys and the loads of the buckets come to the driver."""
    spark = loads.sparkSession
    total = loads.agg(F.sum("load").alias("t")).first().t or 0
    share = max(1.0, total / tasks)
    heavy = loads.where(F.col("load") > share * SPLIT).select(key, "load").collect()
    light = loads.where(F.col("load") <= share * SPLIT).groupBy(_bucket(key, tasks).alias("b")).agg(F.sum("load").alias("load")).collect()
    pieces = [(r.load, 1, str(r.b), ("bucket", r.b)) for r in light]
    for r in heavy:
        n = min(tasks, max(1, round(r.load / (share * SPLIT))))
        pieces.append((r.load / n, n, repr(r[key]), ("key", r[key])))
    slots, queue = _slots(spark, tasks), [(0.0, t) for t in range(tasks)]
    of_bucket, packed = [slots[b % tasks] for b in range(BUCKETS * tasks)], []
    for load, n, _, (what, name) in sorted(pieces, key=lambda p: (-p[0], p[2])):
        took = [heapq.heappop(queue) for _ in range(n)]  # shards of a key go to different tasks
        for x, t in took:
            heapq.heappush(queue, (x + load, t))
        if what == "bucket":
            of_bucket[name] = slots[took[0][1]]
        else:
            packed.append((name, [slots[t] for _, t in took]))
    return Plan(tasks, of_bucket, packed, total, [x for x, _ in sorted(queue, key=lambda q: q[1])])


def _slot(p: Plan, key: str, spread: Column) -> Column:
    lights = F.get(F.lit(p.slots), _bucket(key, p.tasks))
    mine = F.get(F.col("__slots"), F.pmod(spread, F.size("__slots")).cast("int"))
    return F.coalesce(mine, lights)


def route(df: DataFrame, key: str, p: Plan, spread: Column) -> DataFrame:
    """``df`` with its ``slot``, in partitions of one task each. ``spread`` hashes a row to a shard of its key; rows with equal hash stay together."""
    heavy = F.broadcast(p.shards(df.sparkSession, key, df.schema[key].dataType.simpleString()))
    return df.join(heavy, key, "left").withColumn("__slot", _slot(p, key, spread)).drop("__slots").repartition(p.tasks, "__slot")


def join(big: DataFrame, small: DataFrame, key: str, p: Plan) -> DataFrame:
    """Inner join of a skewed table with another one: rows of ``small`` go to every shard of their key and nowhere else. Null keys match nothing.

    Columns of ``small`` that ``big`` has too come out with ``right_`` before their name."""
    small = small.select(*[F.col(c).alias(c if c == key or c not in big.columns else f"right_{c}") for c in small.columns])
    kind = big.schema[key].dataType.simpleString()
    left = route(big.where(F.col(key).isNotNull()), key, p, F.xxhash64(*big.columns))
    heavy = F.broadcast(p.shards(big.sparkSession, key, kind))
    copies = small.where(F.col(key).isNotNull()).join(heavy, key, "left")
    copies = copies.withColumn("__slot", F.explode(F.when(F.col("__slots").isNotNull(), F.array_distinct("__slots")).otherwise(F.array(_slot(p, key, F.lit(0)))))).drop("__slots")
    return left.join(copies.repartition(p.tasks, "__slot"), ["__slot", key]).drop("__slot")


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def combine(df: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """(key, item, n, s, nv): counts and sums of equal (key, item) pairs, combined within each batch before anything is shuffled."""
    kinds = [df.schema[c].dataType.simpleString() for c in (key, item)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_arrays([b.column(0), b.column(1), b.column(2), pc.is_valid(b.column(2)).cast(pa.int64())], ["k", "i", "v", "ok"])
                g = t.group_by(["k", "i"], use_threads=False).aggregate([("ok", "count"), ("v", "sum"), ("ok", "sum")])
                yield from g.select(["k", "i", "ok_count", "v_sum", "ok_sum"]).combine_chunks().to_batches()

    rows = df.select(F.col(key).alias("k"), F.col(item).alias("i"), F.col(value).cast("double").alias("v")).where("k is not null")
    return rows.mapInArrow(fold, f"k {kinds[0]}, i {kinds[1]}, n bigint, s double, nv bigint")


def per_key(df: DataFrame, key: str, item: str, value: str, tasks: int | None = None) -> tuple[DataFrame, int]:
    """((key, n_rows, n_items, sum_value) of every key, number of rows with a key): without any task getting far more than the rest.

    Null keys are left out; null items count as rows, not as items; sum_value is null if all values are. Shards of a key hold different items, so that
    their numbers of distinct items add up; a pair that itself is frequent has been combined before.
    """
    spark = df.sparkSession
    tasks = tasks or tasks_of(spark)
    pairs = write_table(combine(df, key, item, value), "pairs")
    loads = write_table(pairs.groupBy("k").agg(F.count("*").alias("load"), F.sum("n").alias("n")), "loads")
    counted = loads.agg(F.sum("n").alias("n")).first().n or 0
    p = plan(loads, "k", tasks)
    routed = route(pairs, "k", p, F.xxhash64("i"))
    distinct = routed.groupBy("__slot", "k", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    parts = distinct.groupBy("__slot", "k").agg(F.sum("n").alias("n"), F.count("i").alias("items"), F.sum("s").alias("s"))
    out = parts.groupBy("k").agg(F.sum("n").alias("n_rows"), F.sum("items").alias("n_items"), F.sum("s").alias("sum_value"))
    return out.withColumnRenamed("k", key), counted
