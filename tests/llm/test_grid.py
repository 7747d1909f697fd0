import numpy as np
import pytest

from factorloom.llm import grid


def brute(sides, least, smallest):
    out = set()
    for side, m in sides.items():
        u = m.astype(np.float32).astype(float)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        link = u @ u.T >= least
        label = np.arange(len(m))
        while True:
            new = np.array([label[row].min() for row in link]) if len(m) else label
            if (new == label).all():
                break
            label = new
        for root in np.unique(label):
            ids = np.flatnonzero(label == root)
            if len(ids) >= smallest:
                out |= {(side, int(ids.min()), int(i)) for i in ids}
    return out


def table(spark, sides):
    return spark.createDataFrame([(s, i, [float(x) for x in v], 1, "c") for s, m in sides.items() for i, v in enumerate(m)], "side string, id bigint, features array<float>, node int, label string").repartition(3)


def blobs(seed, n=400, dim=8, spread=0.22):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(5, dim))
    m = c[rng.choice(5, n, p=[0.4, 0.3, 0.1, 0.1, 0.1])] + spread * np.abs(c).mean() * rng.normal(size=(n, dim)) * 1.5
    return np.concatenate([m, rng.normal(size=(n // 8, dim)), 3 * m[:5]])


def chain(n=60, dim=6):
    """Neighbours are linked, others aren't: one long path."""
    t = np.arange(n) * 0.6
    return np.stack([np.cos(t / 3), np.sin(t / 3), np.cos(t / 7), np.sin(t / 7), *[np.full(n, 0.1)] * (dim - 4)], axis=1)


@pytest.mark.parametrize("seed,dense", [(0, 4), (1, 16), (2, 1000), (3, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, dense):
    monkeypatch.setattr(grid, "BLOCK", 64)
    monkeypatch.setattr(grid, "PIECE", 16)
    sides = {"x": blobs(seed), "y": blobs(seed + 50, 120, 8)}
    got = {tuple(r) for r in grid.cluster(table(spark, sides), 0.8, 5, axes=3, dense=dense)[0].collect()}
    assert got == brute(sides, 0.8, 5)


def test_bridges_that_are_no_nodes(spark, monkeypatch):
    """Two dense balls that touch only in outlying members, and a single row that touches one."""
    monkeypatch.setattr(grid, "BLOCK", 10_000)
    rng = np.random.default_rng(0)

    def ball(centre, n):
        return centre + 0.02 * rng.normal(size=(n, 5))

    e = np.eye(5)
    edge = lambda a, b, t: (np.cos(t) * e[a] + np.sin(t) * e[b])[None]
    sides = {"x": np.concatenate([ball(e[0], 40), ball(e[1], 40), edge(0, 1, 0.5), edge(1, 0, 0.45), ball(e[2], 40), edge(2, 3, 0.5), edge(2, 3, 1.0), ball(e[4], 4)])}
    got = {tuple(r) for r in grid.cluster(table(spark, sides), 0.8, 5, dense=8)[0].collect()}
    want = brute(sides, 0.8, 5)
    assert got == want and len({r for _, r, _ in want}) == 2


def test_long_chain_and_copies(spark):
    sides = {"x": np.concatenate([chain(), np.repeat(chain()[:1], 30, axis=0)]), "y": np.repeat(np.eye(6)[:1], 3, axis=0)}
    got = {tuple(r) for r in grid.cluster(table(spark, sides), 0.97, 5, dense=16)[0].collect()}
    assert got == brute(sides, 0.97, 5)


def test_too_many_centres_fall_back(spark, monkeypatch):
    monkeypatch.setattr(grid, "CENTRES", 1)
    sides = {"x": blobs(4)}
    assert {tuple(r) for r in grid.cluster(table(spark, sides), 0.8, 5, dense=4)[0].collect()} == brute(sides, 0.8, 5)


def test_description(spark):
    sides = {"x": blobs(5)}
    members, rows = grid.cluster(table(spark, sides))
    sizes = {}
    for s, root, _ in {tuple(r) for r in members.collect()}:
        sizes[s, root] = sizes.get((s, root), 0) + 1
    found = grid.describe(rows, 3).collect()
    assert {(r.side, r.root_id): r.size for r in found} == sizes
    mine = {(r.side, r.id): r.root_id for r in members.collect()}
    for r in found:
        assert 1 <= len(r.typical) <= 3 and all(mine[r.side, i] == r.root_id for i in r.typical) and r.cell_rows <= r.size


def test_empty(spark):
    e = spark.createDataFrame([], "side string, id bigint, features array<float>")
    assert grid.cluster(e)[0].count() == 0


def test_nodes_follow_the_space(spark, monkeypatch):
    """Ten times as many rows in the same places give no more dense nodes to compare."""
    monkeypatch.setattr(grid, "BLOCK", 64)
    seen = []
    keep = grid.heads_of

    def spy(found, least):
        out = keep(found, least)
        seen.append((found.where("dense").count(), out[0].where("dense").count()))
        return out

    monkeypatch.setattr(grid, "heads_of", spy)
    rng = np.random.default_rng(1)
    for n in (200, 2000):
        sides = {"x": np.concatenate([e + 0.05 * rng.normal(size=(n // 4, 4)) for e in np.eye(4)])}
        assert {tuple(r) for r in grid.cluster(table(spark, sides), 0.8, 5, axes=3, dense=4)[0].collect()} == brute(sides, 0.8, 5)
    assert seen[1][0] > seen[1][1] == seen[0][1] == 4


def test_single_nodes_by_key(spark, monkeypatch):
    monkeypatch.setattr(grid, "SINGLES", 0)
    monkeypatch.setattr(grid, "PIECE", 3)
    monkeypatch.setattr(grid, "STREAM", 20)
    rng = np.random.default_rng(7)
    sides = {"x": blobs(6, 150), "y": np.concatenate([blobs(7, 100, 6), rng.normal(size=(60, 6))])}
    sides = {"x": np.pad(sides["x"], ((0, 0), (0, 0))), "y": np.pad(sides["y"], ((0, 0), (0, 2)))}
    assert {tuple(r) for r in grid.cluster(table(spark, sides), 0.8, 5, axes=3, dense=4)[0].collect()} == brute(sides, 0.8, 5)
