import random

import numpy as np
import pytest

from factorloom.llm import runs


def brute(rows, n):
    groups = {}
    for g, s, i in rows:
        if g is not None and s is not None and i is not None and np.isfinite(s):
            groups.setdefault(g, []).append((-(s + 0.0), i))
    return sorted((g, r + 1, i, -s + 0.0) for g, x in groups.items() for r, (s, i) in enumerate(sorted(x)[:n]))


@pytest.mark.parametrize("seed,run_rows,n", [(0, 7, 3), (1, 1000, 10), (2, 1, 2), (3, 50, 1)])
def test_against_sorting(spark, monkeypatch, seed, run_rows, n):
    monkeypatch.setattr(runs, "RUN_ROWS", run_rows)
    rng = random.Random(seed)
    pick = [0.0, -0.0, 1.0, 1.0, 2.5, float("nan"), float("inf"), -float("inf"), None]
    rows = [(rng.choice([1, 1, 1, -5, 2**63 - 1, None, rng.randint(0, 9)]), rng.choice(pick), rng.choice([None, -(2**63), 3, 4, rng.randint(0, 50)])) for _ in range(600)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "g_id bigint, sc float, it bigint, rank int, s double").repartition(3)
    got = sorted((r.g_id, r["rank"], r.it, r.sc) for r in runs.top_per_group(df, "g_id", "sc", "it", n, 3).collect())
    assert got == brute(rows, n)


def test_latest_and_empty(spark):
    inf = float("inf")
    rows = [(1, 5, 1.0, 1), (1, 5, 2.0, 3), (1, 5, 2.0, 3), (1, 5, inf, 4), (1, 6, None, 2), (None, 6, 1.0, 2), (2, 7, float("nan"), 9), (2, 7, 4.0, 8)]
    df = spark.createDataFrame(rows, "u bigint, i bigint, e float, n int")
    assert sorted(tuple(r) for r in runs.latest_of_pair(df, "u", "i", "e", "n").collect()) == [(1, 5, 2.0), (2, 7, 4.0)]
    assert runs.top_per_group(df.limit(0), "u", "e", "i", 3).count() == 0
    with pytest.raises(ValueError):
        runs.top_per_group(df, "u", "e", "i", 0)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_tree_sorts(k):
    rng = random.Random(k)
    parts = [sorted((0, rng.randint(0, 9)) for _ in range(rng.randint(0, 6))) for _ in range(k)]
    tree = runs.LoserTree([p[0] if p else runs.END for p in parts])
    at, out = [0] * k, []
    while tree.heads[tree.winner] is not runs.END:
        w = tree.winner
        out.append(tree.heads[w])
        at[w] += 1
        tree.next(parts[w][at[w]] if at[w] < len(parts[w]) else runs.END)
    assert out == sorted(x for p in parts for x in p)


@pytest.mark.parametrize("held", [3, 10, 100])
def test_bucket_larger_than_what_a_task_holds(spark, monkeypatch, held):
    monkeypatch.setattr(runs, "HELD_ROWS", held)
    monkeypatch.setattr(runs, "RUN_ROWS", 5)
    rng = random.Random(held)
    rows = [(rng.choice([1, 1, 1, rng.randint(0, 9)]), float(rng.randint(0, 6)), rng.randint(0, 50)) for _ in range(700)]
    df = spark.createDataFrame(rows, "g bigint, s double, i bigint").repartition(3)
    assert sorted((r.g, r["rank"], r.i, r.s) for r in runs.top_per_group(df, "g", "s", "i", 4, 2).collect()) == brute(rows, 4)


def test_held_rows_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(runs, "HELD_ROWS", 50)
    most = []
    keep = runs.merge_block
    monkeypatch.setattr(runs, "merge_block", lambda t, n: most.append(t.num_rows) or keep(t, n))
    one = lambda r: pa.record_batch([pa.array([r] * 10), pa.array(range(10)), pa.array([7] * 10), pa.array([float(100 - r - k) for k in range(10)]), pa.array(range(10))], ["run", "pos", "g", "s", "i"])
    out = pa.Table.from_batches(runs.merged((one(r) for r in range(200)), 3))
    assert max(most) <= 60 and out.column("s").to_pylist() == [100.0, 99.0, 99.0] and out.column("rank").to_pylist() == [1, 2, 3]


def test_stored_runs_are_used_again(spark):
    df = spark.createDataFrame([(i % 3, float(i), i) for i in range(60)], "g bigint, s double, i bigint")
    stored = runs.stored_runs(df, "g", "s", "i", 5)
    assert [runs.merge_stored(stored, n).count() for n in (5, 2)] == [15, 6]
