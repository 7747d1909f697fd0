import numpy as np
import pytest

from factorloom.operators import loading, topn


def table(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, features array<double>")


def brute(q, y, n, cosine=False, skip=False):
    out = {}
    for i, a in enumerate(q):
        s = []
        for j, b in enumerate(y):
            v = float(a @ b)
            if cosine:
                d = np.linalg.norm(a) * np.linalg.norm(b)
                if not d:
                    continue
                v /= d
            if not (skip and i == j):
                s.append((-round(v, 9), j))
        if s:
            out[i] = [j for _, j in sorted(s)[:n]]
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("cosine", [True, False])
def test_against_brute_force(spark, monkeypatch, limit, cosine):
    monkeypatch.setattr(topn, "BLOCK", 16)
    rng = np.random.default_rng(0)
    m = rng.integers(-2, 3, size=(50, 3)).astype(float)  # many ties, some zero vectors
    d = table(spark, m)
    got = {r.id: [x.id for x in r.recs] for r in topn.top_n(d, d, 4, cosine=cosine, skip_self=cosine, digits=9, limit_bytes=limit).collect()}
    assert got == brute(m, m, 4, cosine, cosine)


def test_known_items_and_strict_join(spark):
    x = table(spark, np.eye(2))
    known = spark.createDataFrame([(0, [10]), (1, [10, 11])], "user_id bigint, items array<bigint>")
    y = table(spark, [[3.0, 1.0], [2.0, 2.0]], 10)
    got = {r.id: [t.id for t in r.recs] for r in topn.recommend(topn.recommend_work(x, known), y).collect()}
    assert got == {0: [11]}  # the second user knows everything and isn't there
    with pytest.raises(Exception, match="one side only"):
        topn.recommend_work(x, known.where("user_id = 0")).collect()
    tags = spark.createDataFrame([(1,)], "id bigint")
    assert topn.recommend_work(x, known.where("user_id = 0"), tags).count() == 1
    assert topn.recommend(topn.recommend_work(x, known), y, item_tags=spark.createDataFrame([(11,)], "id bigint")).count() == 0


def test_empty(spark):
    e = spark.createDataFrame([], "id bigint, features array<double>")
    assert topn.similar(e).count() == 0 and topn.similar(e, limit_bytes=-1).count() == 0


def test_loading(spark):
    x = spark.createDataFrame([(-1, [1.0]), (2, [1.0]), (5, [2.0])], "id bigint, features array<float>")
    assert sorted(r.id for r in loading.of_partition(x, 2, 3).collect()) == [-1, 2, 5]
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 9)], "id bigint, cluster int")
    centroids = spark.createDataFrame([(0, [1.0]), (4, [1.0])], "cluster int, centroid array<float>")
    assert [tuple(r) for r in loading.clusters(members.where("cluster = 0"), centroids).collect()] == [(0, [1, 2], [1.0])]
    with pytest.raises(Exception, match="no centroid"):
        loading.clusters(members, centroids).collect()


def test_blocks_that_cannot_win_are_not_asked(spark, monkeypatch):
    monkeypatch.setattr(topn, "BLOCK", 32)
    rng = np.random.default_rng(3)
    y = rng.normal(size=(400, 4)) * np.exp(-np.arange(400) / 60)[:, None]
    q = rng.normal(size=(30, 4))
    asked = []
    keep = topn.write_table

    def spy(df, hint):
        out = keep(df, hint)
        if hint == "begun":
            asked.extend(len(r.asked) for r in out.collect())
        return out

    monkeypatch.setattr(topn, "write_table", spy)
    got = {r.id: [x.id for x in r.recs] for r in topn.top_n(table(spark, q), table(spark, y), 3, digits=9, limit_bytes=64 * 5 * 8).collect()}
    assert got == brute(q, y, 3)
    assert len(asked) == 30 and sum(asked) < 0.5 * 30 * (400 // 32 - 2)


def test_part_without_tags(spark):
    y = spark.createDataFrame([(i, [1.0]) for i in range(6)], "id bigint, features array<float>")
    tags = spark.createDataFrame([(3,)], "id bigint")
    assert sorted(r.id for r in loading.of_partition(y, 0, 3, tags).collect()) == [0]
    assert sorted(r.id for r in loading.of_partition(y, None, 1, tags).collect()) == [0, 1, 2, 4, 5]


def test_tiles_that_cannot_win_are_not_scored(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    y, q = rng.normal(size=(60_000, 6)).astype(np.float32), rng.normal(size=(40, 6))
    y[5], y[6, 0], q[3] = 0, np.nan, 0
    ids = rng.permutation(60_000) * 3 - 7
    known = [rng.choice(ids, 30).tolist() + [-1] if i % 4 else None for i in range(40)]
    monkeypatch.setattr(topn, "TILE", 256)
    s = topn.Searched(ids, y, False)
    asked = []

    class Spied(np.ndarray):
        def __getitem__(self, at):
            asked.append(at.stop - at.start)
            return np.asarray(self)[at]

    s.m = s.m.view(Spied)
    monkeypatch.setattr(topn, "GROUP", 8)
    rows, found, values = topn._kernel(5, False, False, None, True)(np.arange(40), q, pa.array(known, pa.list_(pa.int64())), s)
    for i in range(40):
        score = y.astype(float) @ q[i]
        score[~np.isfinite(score) | np.isin(ids, known[i] or [])] = -np.inf
        best = np.lexsort((ids, -score))[:5]
        assert found[rows == i].tolist() == ids[best].tolist() and values[rows == i] == pytest.approx(score[best], abs=1e-12)
    assert sum(asked) < 60_000 * len(topn._tiles(q, 8)[1]) / 2
