import numpy as np

from factorloom.llm import hnsw, vectors


def test_recall_on_the_table(spark, sf):
    """All item vectors of the 0.01 table, in shards of 128 rows: the five nearest in all cells, and every close pair with the reach of the query."""
    rows = vectors.current(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/factors_y.parquet"), "item_id")
    got = {r.id: [x.id for x in r.near] for r in hnsw.neighbours(rows, 5, shard_rows=128, reach=float("inf")).collect()}
    held = rows.collect()
    ids, v = np.array([r.id for r in held]), np.array([r.features for r in held], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    fifth = np.sort(cos, axis=1)[:, -5]
    place = {int(x): i for i, x in enumerate(ids)}
    hits = [sum(cos[place[i], place[j]] >= fifth[place[i]] - 1e-9 for j in near) / 5 for i, near in got.items()]
    assert len(got) == len(ids) and np.mean(hits) >= 0.95
    near = hnsw.neighbours(rows, 5, shard_rows=128)
    pairs = {(r.id_a, r.id_b) for r in hnsw.mutual(near, 0.992).collect()}
    close = (cos >= 0.992) & (cos >= fifth[:, None] - 1e-9) & (cos >= fifth[None] - 1e-9)
    want = {(min(a, b), max(a, b)) for a, b in ((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(close)))}
    assert want and pairs == want


def test_number_of_cells_has_no_ceiling(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "FIT_ROWS", 5)  # fewer than the cells asked for
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)], "id bigint, features array<float>")
    nodes = df.selectExpr("id as node", "features", "array(id) as ids")
    at = hnsw.placed(nodes, 400, 10, 0.13)
    assert at.where("cell is not null").select("node").distinct().count() == 400 and at.select("cell").where("cell is not null").distinct().count() > 20
