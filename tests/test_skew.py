import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factorloom.operators import skew


def data(seed, n=4000):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 1, 2, 2, None, 2**63 - 1, -(2**63)]) if rng.random() < 0.8 else rng.randint(3, 200), rng.choice([None, 5, 5, 5]) if rng.random() < 0.5 else rng.randint(1, 500), rng.choice([None, 1.0, 2.5])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_per_key(spark, seed):
    rows = data(seed)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "u bigint, i bigint, v float, k int, slot int").repartition(5)
    got, total = skew.per_key(df, "u", "i", "v", tasks=6)
    want = defaultdict(lambda: [0, set(), None])
    for u, i, v in rows:
        if u is not None:
            w = want[u]
            w[0] += 1
            if i is not None:
                w[1].add(i)
            if v is not None:
                w[2] = (w[2] or 0) + v
    assert total == sum(w[0] for w in want.values())
    assert {r.u: (r.n_rows, r.n_items, r.sum_value) for r in got.collect()} == {u: (w[0], len(w[1]), w[2]) for u, w in want.items()}


def test_heavy_key_is_spread(spark):
    loads = spark.createDataFrame([(1, 6000), *((k, 10) for k in range(2, 302))], "k bigint, load bigint")
    p = skew.plan(loads, "k", 8)
    assert [k for k, _ in p.heavy] == [1] and p.total == 9000 and len(set(p.heavy[0][1])) >= 6
    df = spark.range(6000).select(F.lit(1).cast("bigint").alias("k"), "id").unionByName(spark.range(3000).select((F.col("id") % 300 + 2).alias("k"), "id"))
    sizes = [r.n for r in skew.route(df, "k", p, F.xxhash64("id")).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1.6 * 9000 / 8


def test_join(spark):
    rows = data(9)
    big = spark.createDataFrame(rows, "u bigint, i bigint, v float")
    small = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (5, "z", 3), (None, "n", 4), (2**63 - 1, "m", 5)], "u bigint, name string, i int")
    loads = big.where("u is not null").groupBy("u").agg(F.count("*").alias("load"))
    got = skew.join(big, small, "u", skew.plan(loads, "u", 5))
    assert got.columns == ["u", "i", "v", "name", "right_i"]
    want = [(u, i, v, n, j) for u, i, v in rows for w, n, j in [(1, "x", 1), (1, "y", 2), (5, "z", 3), (2**63 - 1, "m", 5)] if u == w]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_empty(spark):
    got, total = skew.per_key(spark.createDataFrame([], "u bigint, i bigint, v float"), "u", "i", "v", tasks=3)
    assert total == 0 and got.count() == 0


def test_light_keys_are_packed(spark):
    loads = spark.createDataFrame([(k, 1 + (k * 7919) % 90) for k in range(3000)], "k bigint, load bigint")
    p = skew.plan(loads, "k", 6)
    assert not p.heavy and max(p.loads) < 1.1 * p.total / 6 and sum(p.loads) == p.total
