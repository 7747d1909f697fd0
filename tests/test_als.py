import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.config import Settings
from factorloom.operators import als


def ratings(spark, seed=3, users=12, items=9):
    rng = np.random.default_rng(seed)
    return [(u * 10**12 - 5, i - 4, float(rng.choice([-2, 1, 3]))) for u in range(users) for i in range(items) if rng.random() < 0.6]


def solve(data, y, k, alpha, lam, rebuild=False, observed=False):
    out = {}
    gram = sum(np.outer(v, v) for v in y.values())
    for u in {d[0] for d in data}:
        mine = [(i, r) for x, i, r in data if x == u]
        w = (sum(np.outer(y[i], y[i]) for i, _ in mine) if observed else gram).copy()
        b = np.zeros(k)
        for i, r in mine:
            if rebuild:
                b += r * y[i]
            else:
                w += alpha * abs(r) * np.outer(y[i], y[i])
                b += (1 + alpha * abs(r)) * y[i] * (r > 0)
        out[u] = np.linalg.solve(w + alpha * lam * len(mine) * np.eye(k), b)
    return out


@pytest.mark.parametrize("rebuild,observed", [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("fragment", [4096, 2])
def test_half_step(spark, monkeypatch, rebuild, observed, fragment):
    k, data = 4, ratings(spark)
    rng = np.random.default_rng(5)
    y = {i - 4: rng.normal(size=k) for i in range(9)}
    monkeypatch.setattr(als, "FRAGMENT", fragment)  # pieces of two entries: partial equations are added
    prefs = spark.createDataFrame(data, "user_id bigint, item_id bigint, value double")
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in y.items()], "id bigint, features array<double>")
    s = Settings(features=k, alpha=1.5, lam=0.2, reconstruct_r=rebuild, loss_ignores_unspecified=observed)
    got = {r.id: np.array(r.features) for r in als.half_step(als.ratings_by(prefs, "user_id", "item_id", fragment), factors, s).collect()}
    want = solve(data, y, k, 1.5, 0.2, rebuild, observed)
    assert set(got) == set(want)
    for u in want:
        np.testing.assert_allclose(got[u], want[u], rtol=1e-9)


def test_missing_factor_is_an_error(spark):
    prefs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], "user_id bigint, item_id bigint, value double")
    factors = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, features array<double>")
    with pytest.raises(Exception, match="no factor"):
        als.half_step(als.ratings_by(prefs, "user_id", "item_id"), factors, Settings(features=2)).collect()


def test_agrees_with_mllib_on_positive_ratings(spark):
    from pyspark.ml.recommendation import ALS

    rng = np.random.default_rng(1)
    data = [(u, i, float(rng.integers(1, 5))) for u in range(20) for i in range(12) if rng.random() < 0.5]
    prefs = spark.createDataFrame(data, "user_id int, item_id int, value double")
    model = ALS(rank=3, maxIter=2, implicitPrefs=True, alpha=1.0, regParam=0.1, userCol="user_id", itemCol="item_id", ratingCol="value", seed=1).fit(prefs)
    y = model.itemFactors.select(F.col("id").cast("bigint").alias("id"), "features")
    got = {r.id: np.array(r.features) for r in als.half_step(als.ratings_by(prefs.selectExpr("cast(user_id as bigint) user_id", "cast(item_id as bigint) item_id", "value"), "user_id", "item_id"), y, Settings(features=3)).collect()}
    for r in model.userFactors.collect():
        np.testing.assert_allclose(got[r.id], r.features, atol=1e-4)


def test_loop_stops_and_has_rank(spark):
    rng = np.random.default_rng(2)
    prefs = spark.createDataFrame([(u, i, float(1 + (u + i) % 3)) for u in range(30) for i in range(20) if rng.random() < 0.4], "user_id bigint, item_id bigint, value double")
    m = als.fit(prefs, Settings(features=3, max_iterations=4, convergence_modulus=2))
    assert 2 <= m.iterations <= 4 and m.full_rank and m.x.count() == 30 and m.y.count() <= 20
    assert als.fit(prefs, Settings(features=3, iterate=False)).iterations == 1


def test_stop_rule():
    s = Settings()
    assert not als.stop(1, 0.0, s) and als.stop(2, 0.0005, s) and not als.stop(2, 0.01, s) and als.stop(2, float("nan"), s) and als.stop(30, 1.0, s)
    many = Settings(max_iterations=0)
    assert not als.stop(1, 0.0, many) and not als.stop(500, 0.1, many) and als.stop(2, 0.0005, many) and als.stop(1, 1.0, Settings(max_iterations=1))


@pytest.mark.parametrize("fragment", [4096, 2])
def test_factors_sent_or_joined(spark, fragment):
    """Blocks are packed once; both ways to their factors give what numpy gives."""
    data, rng = ratings(spark), np.random.default_rng(5)
    y = {i - 4: rng.normal(size=4).astype(np.float32) for i in range(9)}
    prefs = spark.createDataFrame(data, "user_id bigint, item_id bigint, value double")
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in y.items()], "id bigint, features array<float>")
    packed = als.pack(als.ratings_by(prefs, "user_id", "item_id", fragment, 20))
    assert packed.select("block").distinct().count() == packed.count() > 1
    want = solve(data, {i: v.astype(float) for i, v in y.items()}, 4, 1.5, 0.2)
    for limit in (0, 1 << 20):
        got = {r.id: r.features for r in als.half_step(packed, factors, Settings(features=4, alpha=1.5, lam=0.2), limit_bytes=limit).collect()}
        assert set(got) == set(want)
        for u in want:
            np.testing.assert_allclose(got[u], want[u], rtol=1e-9)


def test_many_rows_of_one_entry_are_taken_in_parts():
    y, k, n = np.random.default_rng(1).normal(size=(7, 50)), 50, 20_000
    at = np.arange(n) % 7
    parts = list(als._sums(y, at, np.ones(n), np.ones(n), np.arange(n)))
    assert max(w.size for _, w, _ in parts) <= als.CHUNK and sorted(np.concatenate([r for r, _, _ in parts])) == list(range(n))
    for rows, w, rhs in parts:
        np.testing.assert_allclose(w[-1], np.outer(y[at[rows[-1]]], y[at[rows[-1]]]))
        np.testing.assert_allclose(rhs, y[at[rows]])


@pytest.mark.parametrize("chunk", [1 << 22, 8])
def test_change_from_vectors(spark, monkeypatch, chunk):
    rng = np.random.default_rng(4)
    tables = [spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "id bigint, features array<double>") for _ in range(4)]
    (x, y), (x0, y0) = tables[:2], tables[2:]
    want = als.convergence_value(als.convergence_sample(x, y, 3), als.convergence_sample(x0, y0, 3)).first().value
    monkeypatch.setattr(als, "CHUNK", chunk)  # few products at a time: they are added up by tasks
    assert als._change(spark, als._sample(als.sampled(x, y, 3)), als._sample(als.sampled(x0, y0, 3))) == pytest.approx(want)
