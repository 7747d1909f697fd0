import numpy as np
import pytest

from factorloom.llm import hnsw, vectors


def table(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(range(len(m)) if ids is None else ids, m)], "id bigint, features array<float>")


def brute(m, k):
    u = m.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    return [np.lexsort((np.arange(len(s)), -row))[:k] for row in s], s


def data(n=1500, dim=12, groups=6, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim))
    m = c[rng.choice(groups, n, p=[0.4, 0.3] + [0.3 / (groups - 2)] * (groups - 2))] + 0.25 * rng.normal(size=(n, dim))
    m[::10] = m[1::10][: len(m[::10])] + 0.01 * rng.normal(size=m[::10].shape)
    return m


@pytest.mark.parametrize("shard_rows", [10_000, 200])
def test_recall_and_close_pairs(spark, shard_rows):
    m = data()
    want, s = brute(m, 5)
    near = hnsw.neighbours(table(spark, m), 5, shard_rows=shard_rows, reach=0.15)
    got = {r.id: [x.id for x in r.near] for r in near.collect()}
    assert set(got) == set(range(len(m))) and all(len(v) == 5 and i not in v for i, v in got.items())
    assert np.mean([len(set(got[i]) & set(want[i].tolist())) / 5 for i in got]) >= 0.9
    pairs = {(i, int(j)) for i in range(len(m)) for j in want[i] if i < j and s[i, j] >= 0.992 and i in want[j]}
    found = {(r.id_a, r.id_b) for r in hnsw.mutual(near, 0.992).collect()}
    assert pairs and found == pairs


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 6))
    m = np.concatenate([np.repeat(m[:1], 60, axis=0), m, 2 * m[5:6]])  # one vector holds more than half of the rows
    ids = [7 - 3 * i for i in range(len(m))]
    got = {r.id: [x.id for x in r.near] for r in hnsw.neighbours(table(spark, m, ids), 3).collect()}
    copies = sorted(ids[:61])
    for i in copies:
        assert got[i] == [x for x in copies if x != i][:3]
    assert got[ids[65]][0] == ids[-1] and got[ids[-1]][0] == ids[65]


def test_few_rows(spark):
    assert hnsw.neighbours(table(spark, []), 3).count() == 0
    assert [(r.id, list(r.near)) for r in hnsw.neighbours(table(spark, np.eye(3)[:1]), 3).collect()] == [(0, [])]
    assert {r.id: sorted(x.id for x in r.near) for r in hnsw.neighbours(table(spark, np.eye(3)), 5).collect()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}


def test_current_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (1, None, 2), (2, [1.0, 2.0], 1), (2, [3.0, 4.0], 3), (2, [3.0, 4.0], 3), (3, [0.0, 0.0], 1), (4, [1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [0.0, -1.0], 1), (9, [], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k bigint, features array<float>, generation_id bigint, id string")
    assert sorted((r.id, list(r.features)) for r in vectors.current(df, "k", 2).collect()) == [(2, [3.0, 4.0]), (8, [0.0, -1.0])]
