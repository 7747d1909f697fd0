import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import incremental as inc

T0 = dt.datetime(2030, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def brute(deltas, runs):
    def done(d):
        return d[4] is not None and any(r[0] == d[3] and r[3] and (-1 if r[1] is None else r[1]) < d[4] <= r[2] and d[5] <= r[4] for r in runs)

    writes = {}
    for d in deltas:
        writes.setdefault((d[3], d[1]), ([], []))[done(d)].append(d)
    out = []
    for new, old in writes.values():
        if new:
            best = max(d[2] for d in new)
            if not old or best > max(d[2] for d in old):
                out.append(min(d[0] for d in new if d[2] == best))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_pending_writes(spark, seed):
    rng = random.Random(seed)
    deltas = [(i if i % 7 else -i, rng.randint(1, 40), rng.randint(1, 4), rng.choice("ab"), rng.choice([None, 0, 1, 2, 3, 4]), at(rng.randint(0, 50))) for i in range(1, 300)]
    runs = [(rng.choice("ab"), rng.choice([None, -1, 0, 1, 2]), rng.randint(0, 4), rng.choice([True, True, False, None]), at(rng.randint(0, 50))) for _ in range(8)]
    runs += runs[:2]
    d = spark.createDataFrame(deltas, "rec_id bigint, write_id bigint, revision int, instance_id string, generation_id bigint, landed_at timestamp").withColumn("seen_until", F.lit("clash"))
    r = spark.createDataFrame(runs, "instance_id string, last_generation_id bigint, generation_id bigint, done_marker boolean, started_at timestamp")
    assert sorted(x.rec_id for x in inc.pending_writes(d, r).collect()) == brute(deltas, runs)
    assert inc.pending_writes(d.limit(0), r).count() == 0
    assert inc.pending_writes(d, r.limit(0)).count() == len({(x[3], x[1]) for x in deltas})


def source(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


def test_only_changed_partitions_are_recomputed(spark, tmp_path):
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    seen = []

    def total(df):
        seen.append(sorted({r.k or "null" for r in df.collect()}))
        return df.groupBy("k").agg(F.sum("v").alias("v"))

    def result():
        return {r.k: r.v for r in spark.read.parquet(target).collect()}

    rows = [("a", 1), ("a", 2), ("b", 5), (None, 7)]
    assert inc.refresh(source(spark, rows), ["k"], total, target, state) == 3
    assert result() == {"a": 3, "b": 5, None: 7}
    assert inc.refresh(source(spark, rows[::-1]), ["k"], total, target, state) == 0  # order doesn't matter
    rows = [("a", 1), ("a", 2), ("a", 2), (None, 8), ("c", 1)]
    assert inc.refresh(source(spark, rows), ["k"], total, target, state) == 4  # b has gone
    assert result() == {"a": 5, "c": 1, None: 8} and seen == [["a", "b", "null"], ["a", "c", "null"]]


def test_failed_run_is_made_up_for(spark, tmp_path):
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    inc.refresh(source(spark, [("a", 1)]), ["k"], lambda d: d, target, state)

    def fail(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        inc.refresh(source(spark, [("a", 1), ("b", 2)]), ["k"], fail, target, state)
    assert inc.refresh(source(spark, [("a", 1), ("b", 2)]), ["k"], lambda d: d, target, state) == 1
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 2)]


def test_fingerprints_see_nulls_and_copies(spark):
    df = spark.createDataFrame([("p", None, 1), ("q", 1, None), ("r", 1, 1), ("s", 1, 1), ("s", 1, 1)], "k string, a int, b int")
    f = {r.k: (r.n_rows, r.row_sum) for r in inc.fingerprints(df, ["k"], ["a", "b"]).collect()}
    assert len(set(f.values())) == 4
    assert inc.fingerprints(df.limit(0), ["k"], ["a"]).count() == 0


def test_changed_partition_without_results_is_removed(spark, tmp_path):
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    keep = lambda df: df.where("v < 10")
    assert inc.refresh(source(spark, [("a", 1), ("b", 2), ("", 3)]), ["k"], keep, target, state) == 3
    assert inc.refresh(source(spark, [("a", 11), ("b", 2), ("", 3)]), ["k"], keep, target, state) == 1
    assert sorted((r.k or "", r.v) for r in spark.read.parquet(target).collect()) == [("", 3), ("b", 2)]
    assert inc.refresh(source(spark, [("a", 1), ("b", 2), ("", 12)]), ["k"], keep, target, state) == 2
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 2)]


WRITES = "rec_id bigint, write_id bigint, revision int, instance_id string, generation_id bigint, landed_at timestamp"


def scanned(df) -> int:
    """Rows that the scan of a plan gave, after it has run."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        p = stack.pop()
        name = p.nodeName()
        if name.startswith("Scan parquet"):
            n += p.metrics().apply("numOutputRows").value()
        for get in ("executedPlan", "plan"):
            if (get, name.split()[0]) in {("executedPlan", "AdaptiveSparkPlan"), ("plan", "ShuffleQueryStage"), ("plan", "BroadcastQueryStage"), ("plan", "ResultQueryStage")}:
                stack.append(getattr(p, get)())
        kids = p.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return n


def test_unchanged_partitions_are_not_read(spark, tmp_path):
    at, path = str(tmp_path / "at"), str(tmp_path / "deltas")
    first = [(g * 1000 + i, g * 1000 + i, 1, "a", g, at_(0)) for g in range(8) for i in range(500)]
    spark.createDataFrame(first, WRITES).write.partitionBy("instance_id", "generation_id").parquet(path)
    read = lambda: spark.read.schema(WRITES).parquet(path).select("rec_id", "write_id", "revision", "instance_id", "generation_id", "landed_at")
    inc.commit(read(), f"{at}/taken", f"{at}/state")
    assert inc.due(read(), f"{at}/taken", f"{at}/state").count() == 0
    more = [(90_000, 3007, 2, "a", 3, at_(1)), (90_001, 3008, 1, "a", 3, at_(1)), (90_002, 77_000, 1, "a", 3, at_(1)), (90_003, 5001, 9, "a", 3, at_(1))]  # the last one is a later revision of a write of another partition
    spark.createDataFrame(more, WRITES).write.mode("append").partitionBy("instance_id", "generation_id").parquet(path)
    rows = inc.plain_keys(read().select(*inc.COLUMNS), inc.KEYS)
    changed = inc.compare(inc.fingerprints(rows, inc.KEYS, sorted(inc.COLUMNS)), f"{at}/state", inc.KEYS)
    assert [(r.generation_id, r.n_rows) for r in changed.collect()] == [(3, 504)]
    assert scanned(inc.rows_of(rows, changed, inc.KEYS)) == 504
    assert sorted(r.rec_id for r in inc.due(read(), f"{at}/taken", f"{at}/state").collect()) == [90_000, 90_002, 90_003]
    assert inc.commit(read(), f"{at}/taken", f"{at}/state") == 1
    assert inc.due(read(), f"{at}/taken", f"{at}/state").count() == 0


def test_rows_come_through_the_fingerprints(spark, monkeypatch):
    rows = [(1, 1, 1, "a", 1, at_(0)), (2, 1, 2, "a", 1, at_(9)), (3, 2, 1, "a", 2, at_(9))]
    d = spark.createDataFrame(rows, WRITES)
    r = spark.createDataFrame([("a", None, 2, True, at_(5))], "instance_id string, last_generation_id bigint, generation_id bigint, done_marker boolean, started_at timestamp")
    assert sorted(x.rec_id for x in inc.pending_writes(d, r).collect()) == [2, 3]
    monkeypatch.setattr(inc, "fingerprints", lambda df, keys, columns: df.groupBy(*keys).agg(F.lit(1).alias("n_rows"), F.lit(0).cast("decimal(30,0)").alias("row_sum")))
    assert [x.rec_id for x in inc.pending_writes(d, r).collect()] == [3]  # a partition that looks the same is not read again


def at_(h):
    return at(h)
