import random
from collections import Counter

import pytest

from factorloom.llm import frequent


def data(seed):
    rng = random.Random(seed)
    heavy = [0, -1, 2**63 - 1, -(2**63), 77]
    return [rng.choice(heavy) if rng.random() < 0.5 else rng.choice([None, rng.randint(-(10**12), 10**12)]) for _ in range(5000)]


@pytest.mark.parametrize("seed,width", [(0, 2048), (1, 16), (2, 1)])  # with few buckets the sketch can't tell, and the exact way must
def test_against_counting(spark, seed, width):
    values = data(seed)
    df = spark.createDataFrame([(v, 1) for v in values], "x bigint, item int").repartition(4)
    count = Counter(v for v in values if v is not None)
    need = 0.01 * sum(count.values())
    got = {r.x: (r.n_rows, r.estimate) for r in frequent.frequent(df, "x", 0.01, width=width).collect()}
    assert {x: n for x, (n, _) in got.items()} == {x: n for x, n in count.items() if n >= need}
    assert all(e >= n for n, e in got.values())


def test_exact_share_counts(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 100)] + [(7,)], "x bigint")
    assert [(r.x, r.n_rows) for r in frequent.frequent(df, "x", 0.02).collect()] == [(7, 2)]


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "x bigint")
    assert frequent.frequent(df, "x", 0.5).count() == 0 and frequent.frequent(df.limit(0), "x", 0.5).count() == 0
    with pytest.raises(ValueError):
        frequent.frequent(df, "x", 0)


def test_small_and_odd_shares(spark):
    assert frequent.least_count(10**10, 4e-7) == 4000 and frequent.least_count(1000, 0.005) == 5 and frequent.least_count(1001, 0.005) == 6 and frequent.least_count(3, 1 / 3) == 1
    df = spark.createDataFrame([(i,) for i in range(300)] + [(7,), (7,)], "x bigint")
    got = {r.x: r.n_rows for r in frequent.frequent(df, "x", 4e-7, width=4).collect()}  # every value counts, and none comes to the driver by itself
    assert len(got) == 300 and got[7] == 3
