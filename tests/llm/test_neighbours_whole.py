from functools import partial

import numpy as np

from factorloom.llm import hnsw, vectors
from factorloom.llm.queries import QUERIES


def test_neighbours_behind_any_border(spark, sf, monkeypatch):
    rows = vectors.current(spark.read.parquet(f"{sf}/factors_y.parquet"), "item_id").collect()
    ids, v = np.array([r.id for r in rows]), np.array([r.features for r in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    monkeypatch.setattr(hnsw, "neighbours", partial(hnsw.neighbours, shard_rows=12))
    got: dict[int, list] = {}
    for r in QUERIES["p6_neighbours"](spark, sf).collect():
        got.setdefault(r.id, []).append(r.cosine)
    for i, c in zip(ids.tolist(), cos):
        assert np.allclose(sorted(got[i]), np.sort(c)[-5:], atol=2e-6)
