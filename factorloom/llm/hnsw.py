"""Most similar vectors of every vector: hierarchical small-world graphs, one for each shard, with results merged.

Vectors are sharded by the nearest of some centroids, of which there are two levels: a vector is compared with the few centroids of the first, then with those
below the nearest, about two roots of the number of shards in all. Cells of more than a shard's rows are cut further by hash, so every row is indexed and no
shard is unbounded. A query goes to its own cell and to the cells whose border is near enough that a close partner may lie behind it. A graph is a few flat
arrays of neighbour numbers, one a level, with nodes of higher levels first; all queries of a batch advance together. Equal vectors are one node; of its ids
no more than can occur in a result are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import lists, matrix
from ..session import write_table
from .runs import top_per_group

#: Neighbours of a node on level 0 and above, candidates while building, breadth of a search, rows of a batch.
M0, M, EF_BUILD, EF, BATCH = 20, 12, 32, 24, 1024
#: Nodes that are expanded at a time.
STEP = 4
#: Rows that a cell should have, and times as many from which it is cut: its pieces are all asked, so an uneven cell is better left whole.
SHARD_ROWS, UNEVEN = 4096, 3
#: Rows to which the centroids of the first level are fitted, and for each centroid of the second; rows of a task that compares with those. All rows are indexed.
FIT_ROWS, FIT_EACH, PLACE_ROWS = 20_000, 64, 500_000
#: Distance of unit vectors within which partners across a border are looked for (0.13: cosine 0.9915).
REACH = 0.13
#: Cells up to which their table is sent to every executor (24 bytes each).
SMALL_CELLS = 500_000
NEAR = "array<struct<neg: double, id: bigint>>"


@dataclass
class Graph:
    vectors: np.ndarray  # unit rows, nodes of high levels first
    levels: list[np.ndarray]  # from level 0 up: [nodes of the level, neighbours], -1 for none


def _search(vec: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) [queries, ef] of the best nodes found from ``entry`` [queries, any], in descending order, -1 and -inf where there are fewer."""
    n = len(q)
    rows = np.arange(n)
    seen = np.zeros((n, len(links)), bool)
    width = max(ef, entry.shape[1])
    ids = np.full((n, width), -1, np.int32)
    sims = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    e = entry.shape[1]
    ids[:, :e] = entry
    ok = entry >= 0
    sims[:, :e] = np.where(ok, np.matmul(vec[entry], q[:, :, None])[:, :, 0], -np.inf)
    done[:, :e] = ~ok
    seen[np.repeat(rows, e)[ok.ravel()], entry[ok]] = True
    live = rows
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        step = min(STEP, width)
        pick = np.argpartition(-open_sims, step - 1, axis=1)[:, :step]
        good = np.take_along_axis(open_sims, pick, 1) > -np.inf
        alive = good.any(axis=1)
        if not alive.all():
            live, pick, good = live[alive], pick[alive], good[alive]
            if not len(live):
                break
        done[live[:, None], pick] = True
        near = links[np.where(good, ids[live[:, None], pick], 0)]
        near = np.where(good[:, :, None], near, -1).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        near = np.sort(np.where(fresh, near, -1), axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        score = np.full(near.shape, -np.inf, np.float32)
        score[r, c] = np.einsum("ij,ij->i", vec[near[r, c]], q[live[r]])
        all_sims = np.concatenate([sims[live], score], axis=1)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live], ids[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_sims, all_ids, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
    sims = np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims


def _choose(vec: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """m neighbours [rows, m] out of candidates in descending order: those nearer to the node than to any chosen before, then the nearest of the rest."""
    n, c = ids.shape
    out = np.full((n, m), -1, np.int32)
    for a in range(0, n, BATCH):
        i, s = ids[a : a + BATCH], sims[a : a + BATCH]
        v = vec[np.maximum(i, 0)]
        cross = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(i.shape, bool)
        nearest = np.full(i.shape, -np.inf, np.float32)  # of each candidate to a chosen one
        for k in range(c):
            take = (i[:, k] >= 0) & (s[:, k] > nearest[:, k]) & (kept.sum(axis=1) < m)
            kept[:, k] = take
            nearest = np.where(take[:, None], np.maximum(nearest, cross[:, k]), nearest)
        rank = np.where(kept, 0, np.where(i >= 0, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1, kind="stable")[:, :m]
        got = np.take_along_axis(i, order, 1)
        out[a : a + BATCH, : got.shape[1]] = got
    return out


def _link_back(vec: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Adds the edges from chosen nodes back to new ones; full lists are chosen anew."""
    m = links.shape[1]
    src = np.repeat(new, chosen.shape[1])
    dst = chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    sim = np.einsum("ij,ij->i", vec[src], vec[dst])
    order = np.lexsort((-sim, dst))
    src, dst, sim = src[order], dst[order], sim[order]
    nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(start, count)
    room = min(m, int(count.max())) if len(count) else 0
    more = np.full((len(nodes), room), -1, np.int32)
    fits = place < room
    more[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = src[fits]
    every = np.concatenate([links[nodes], more], axis=1)
    s = np.where(every >= 0, np.einsum("ijk,ik->ij", vec[np.maximum(every, 0)], vec[nodes]), -np.inf).astype(np.float32)
    order = np.argsort(-s, axis=1, kind="stable")
    every, s = np.take_along_axis(every, order, 1), np.take_along_axis(s, order, 1)
    full = (every >= 0).sum(axis=1) > m
    links[nodes[~full]] = every[~full, :m]
    if full.any():
        links[nodes[full]] = _choose(vec, every[full], s[full], m)


def build(vectors: np.ndarray, seed: int = 1) -> tuple[Graph, np.ndarray]:
    """The graph of unit rows, and the position in ``vectors`` of each of its nodes.

    Candidates of the nodes of a level are found by products of blocks, as a shard is bounded; neighbours are chosen from them and linked back."""
    n = len(vectors)
    level = (-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
    order = np.argsort(-level, kind="stable")
    vec, level = np.ascontiguousarray(vectors[order], np.float32), level[order]
    sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)] if n else [0]
    graph = Graph(vec, [np.zeros((0, M), np.int32)] * len(sizes))
    for k in range(len(sizes) - 1, -1, -1):
        m, size = (M0 if k == 0 else M), sizes[k]
        links = np.full((size, m), -1, np.int32)
        top = min(EF_BUILD, size)
        for at in range(0, size, BATCH):
            to = min(size, at + BATCH)
            inner = vec[at:to] @ vec[:size].T
            inner[np.arange(to - at), np.arange(at, to)] = -np.inf
            near = np.argpartition(-inner, top - 1, axis=1)[:, :top]
            sims = np.take_along_axis(inner, near, 1)
            by = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(near, by, 1).astype(np.int32), np.take_along_axis(sims, by, 1)
            links[at:to] = _choose(vec, np.where(sims > -np.inf, ids, -1), sims, m)
        for at in range(0, size, BATCH):
            new = np.arange(at, min(size, at + BATCH), dtype=np.int32)
            _link_back(vec, links, new, links[new].copy())
        graph.levels[k] = links
    return graph, order


def _entry(graph: Graph, q: np.ndarray, level: int, limit: int) -> np.ndarray:
    """Where a search on ``level`` begins: the best few nodes of the levels above; those exist before any node that is on this level alone."""
    entry = np.zeros((len(q), 1), np.int32)
    for k in range(len(graph.levels) - 1, level, -1):
        links = graph.levels[k][:limit]
        if len(links):
            links = np.where(links < len(links), links, -1)
            entry = _search(graph.vectors, links, q, entry[:, :4], 8)[0]
    return np.where(entry >= 0, entry, entry[:, :1])[:, :4]


def query(graph: Graph, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Nodes [queries, k + 4] in about descending order of similarity, -1 where there are fewer. ``own``: the nodes of the queries themselves, if they have one."""
    links = graph.levels[0]
    out = []
    for a in range(0, len(q), BATCH):
        part = q[a : a + BATCH]
        entry = own[a : a + BATCH, None] if own is not None else _entry(graph, part, 0, len(links))
        out.append(_search(graph.vectors, links, part, entry.astype(np.int32), max(EF, k + 4))[0][:, : k + 5])
    return np.concatenate(out) if out else np.zeros((0, k + 5), np.int32)


def fitted(v: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """Directions of at most ``count`` cells of some rows."""
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    c = v[rng.permutation(len(v))[:count]]
    for _ in range(8):
        at = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, v)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    return c


def asked(sim: np.ndarray, best: np.ndarray, half: np.ndarray, reach: float) -> np.ndarray:
    """Which cells [rows, cells] have a border within ``reach`` of unit rows: sim are the products with the centroids, best the number of the nearest, half the distances of centroids.

    The border of cell b seen from cell a is at (sim a - sim b) / distance of the centroids, as |v - c|² = 2 - 2 v·c."""
    with np.errstate(all="ignore"):
        border = (sim[np.arange(len(sim)), best][:, None] - sim) / half[best]
    out = ~(border > reach)  # of equal centroids both
    out[np.arange(len(sim)), best] = True
    return out


def _list(mask: np.ndarray, names: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(mask.sum(axis=1))]).astype(np.int32)), pa.array(np.broadcast_to(names, mask.shape)[mask]))


def placed(nodes: DataFrame, total: int, shard_rows: int, reach: float, seed: int = 1) -> DataFrame:
    """(node, features, ids, cell, asked): a row of each node with its cell and ids, and rows with null cell and ids for cells it asks elsewhere. Nodes: node, features, ids.

    Cells are numbered by both levels of centroids. A partner within ``reach`` of a node lies in a cell that the node asks: it does on each level."""
    spark = nodes.sparkSession
    count = max(1, -(-total // shard_rows))
    rough = max(1, math.isqrt(count))
    first = fitted(matrix(nodes.orderBy(F.xxhash64("node", F.lit(seed))).limit(FIT_ROWS).select("features").toArrow().column(0)), rough, seed)
    half = np.linalg.norm(first[:, None] - first[None], axis=2)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1))
                sim = v @ first.T / np.linalg.norm(v, axis=1, keepdims=True)
                own = sim.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), _list(asked(sim, own, half, reach), np.arange(len(first), dtype=np.int32))], ["node", "features", "ids", "top", "tops"])

    rows = write_table(nodes.select("node", "features", "ids").mapInArrow(top, "node bigint, features array<float>, ids array<bigint>, top int, tops array<int>"), "tops")
    sizes = {r.top: r.n for r in rows.groupBy("top").agg(F.count("*").alias("n")).collect()}  # about the root of the number of shards
    below = {t: -(-n // shard_rows) for t, n in sizes.items()}
    kinds = spark.createDataFrame([(t, below[t], min(1.0, FIT_EACH * below[t] / n)) for t, n in sizes.items()], "top int, cells int, part double")
    sample = rows.join(F.broadcast(kinds), "top").where(F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(1 << 30)) < F.col("part") * (1 << 30)).select("top", "cells", "features")

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        c = fitted(matrix(t.column("features")), t.column("cells")[0].as_py(), seed)
        return pa.table([pa.array(np.full(len(c), key[0].as_py(), np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), lists(c)], names=["top", "sub", "features"])

    second = write_table(sample.groupBy("top").applyInArrow(fit, T._parse_datatype_string("top int, sub int, features array<double>")), "centroids")
    asks = rows.withColumn("to", F.explode("tops")).select(F.col("to").alias("top"), "node", "features", F.when(F.col("to") == F.col("top"), F.col("ids")).alias("ids"))
    parts = {r.top: -(-r.n // PLACE_ROWS) for r in asks.groupBy("top").agg(F.count("*").alias("n")).collect()}
    many = F.broadcast(spark.createDataFrame(list(parts.items()), "top int, parts int"))
    asks = asks.join(many, "top").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    held = second.join(many, "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["top", "part", "role", "node", "features", "ids"]
    both = held.select("top", "part", F.lit(0).alias("role"), F.col("sub").cast("bigint").alias("node"), F.transform("features", lambda x: x.cast("double")).alias("features"), F.lit(None).cast("array<bigint>").alias("ids"))
    both = both.unionByName(asks.select("top", "part", F.lit(1).alias("role"), "node", F.col("features").cast("array<double>").alias("features"), "ids"))

    def sub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, c, between, names = None, [], None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(x).to_numpy() for x in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
            for lo, hi in zip(cuts, cuts[1:]):
                name, some = tuple(key[:2, lo]), b.slice(lo, hi - lo)
                if key[2, lo] == 0:
                    if name != at:
                        at, parts = name, []
                    parts.append(some)
                    c = None
                    continue
                if c is None:
                    t = pa.Table.from_batches(parts)
                    c, names = matrix(t.column("features")), t.column("node").to_numpy() + (int(name[0]) << 32)
                    between = np.linalg.norm(c[:, None] - c[None], axis=2)
                v = matrix(some.column(4))
                sim = v @ c.T / np.linalg.norm(v, axis=1, keepdims=True)
                best = sim.argmax(axis=1)
                mine = np.asarray(some.column(5).is_valid())
                cell = pa.array(names[best], mask=~mine)
                yield pa.RecordBatch.from_arrays([some.column(3), some.column(4).cast(pa.list_(pa.float32())), some.column(5), cell, _list(asked(sim, best, between, reach), names)], ["node", "features", "ids", "cell", "asked"])

    spread = both.repartition("top", "part").sortWithinPartitions("top", "part", "role")
    return write_table(spread.select(*cols).mapInArrow(sub, "node bigint, features array<float>, ids array<bigint>, cell bigint, asked array<bigint>"), "cells")


def neighbours(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, reach: float = REACH) -> DataFrame:
    """(id, near ARRAY<STRUCT<id, cosine>>): about the k vectors of highest cosine to each, without itself, ties by smaller id; fewer if there are fewer.

    vectors: id (unique), features (usable ones of one length). Approximate: recall is measured against brute force in the tests and stated in the README.
    Partners at a distance of ``reach`` or less are looked for in every cell that can have them. Copies of a vector are partners of cosine 1. One row an id,
    with an empty list if it is alone.
    """
    spark = vectors.sparkSession
    rows = write_table(vectors.select("id", "features", F.xxhash64("features").alias("node")), "vectors")
    kinds = rows.groupBy("node").agg(F.any_value("features").alias("features"), F.min("id").alias("first"), F.count("*").alias("n"))
    kinds = write_table(kinds, "nodes")
    total = kinds.count()
    if not total:
        return spark.createDataFrame([], "id bigint, near array<struct<id: bigint, cosine: double>>")
    many = kinds.where("n > 1").select("node")
    copies = top_per_group(rows.join(many, "node", "left_semi").select("node", "id", F.lit(0.0).alias("s")), "node", "s", "id", k + 1).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = kinds.join(copies, "node", "left").select("node", "features", F.coalesce("ids", F.array("first")).alias("ids"))
    at = placed(nodes, total, shard_rows, reach)
    cells = write_table(at.where("cell is not null").groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / (UNEVEN * shard_rows)).cast("int").alias("parts")), "parts")
    shards = cells.agg(F.sum("parts").alias("n"), F.count("*").alias("cells")).first()
    small = F.broadcast(cells) if shards.cells <= SMALL_CELLS else cells
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts").cast("bigint")).cast("int")
    index = at.where("cell is not null").withColumn("c", F.col("cell")).join(small, "c").select("c", mine.alias("p"), F.lit(0).alias("role"), "node", "features", "ids")
    asks = at.select("node", "features", "cell", F.explode("asked").alias("c")).join(small, "c")
    asks = asks.select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), mine.alias("mine"), "node", "features", "cell")
    own = F.coalesce(F.col("cell") == F.col("c"), F.lit(False)) & (F.col("p") == F.col("mine"))
    asks = asks.where(~own).select("c", "p", F.lit(1).alias("role"), "node", "features", F.lit(None).cast("array<bigint>").alias("ids"))
    tasks = index.unionByName(asks)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"shard": None, "held": [], "graph": None}

        def results(node: np.ndarray, raw: np.ndarray, own: np.ndarray | None) -> pa.RecordBatch:
            g, order, data, size, ids = state["graph"], state["order"], state["raw"], state["norm"], state["ids"]
            norm = np.linalg.norm(raw, axis=1)
            got = query(g, (raw / norm[:, None]).astype(np.float32), k, own)
            at = np.where(got >= 0, order[np.maximum(got, 0)], -1)
            cos = np.einsum("ijk,ik->ij", data[np.maximum(at, 0)], raw) / (size[np.maximum(at, 0)] * norm[:, None])
            near = []
            for i in range(len(at)):
                found = {(-c, x) for c, j in zip(cos[i].tolist(), at[i].tolist()) if j >= 0 for x in ids[j]}  # a small graph may give a node more than once
                near.append([{"neg": c, "id": x} for c, x in sorted(found)[: k + 1]])
            kind = pa.list_(pa.struct([("neg", pa.float64()), ("id", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(near, kind)], ["node", "near"])

        def open_shard() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(state["held"]).combine_chunks()
            state["held"] = []
            raw = matrix(t.column("features"))
            norm = np.linalg.norm(raw, axis=1)
            graph, order = build((raw / norm[:, None]).astype(np.float32))
            state.update(graph=graph, order=order, raw=raw, norm=norm, ids=t.column("ids").to_pylist())
            node = t.column("node").to_numpy()
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.arange(len(order))
            for a in range(0, len(node), 8 * BATCH):
                yield results(node[a : a + 8 * BATCH], raw[a : a + 8 * BATCH], inverse[a : a + 8 * BATCH])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
            for a, z in zip(cuts, cuts[1:]):
                part, shard, role = b.slice(a, z - a), tuple(key[:2, a]), key[2, a]
                if (shard != state["shard"] or role == 1) and state["held"]:
                    yield from open_shard()
                if role == 0:
                    state["shard"] = shard
                    state["held"].append(part)
                elif shard == state["shard"]:  # else a part of a cell that got no rows
                    yield results(part.column(3).to_numpy(), matrix(part.column(4)), None)
        if state["held"]:
            yield from open_shard()

    spread = tasks.select("c", "p", "role", "node", "features", "ids").repartitionByRange(max(1, min(shards.n, 4096)), "c", "p").sortWithinPartitions("c", "p", "role")
    found = spread.mapInArrow(answer, f"node bigint, near {NEAR}")
    merged = found.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))  # k + 1 for each shard asked
    each = rows.select("id", "node").join(merged, "node", "left")
    others = F.slice(F.filter(F.coalesce("near", F.array().cast(NEAR)), lambda x: x["id"] != F.col("id")), 1, k)
    return each.select("id", F.transform(others, lambda x: F.struct(x["id"].alias("id"), (-x["neg"]).alias("cosine"))).alias("near"))


def mutual(near: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: pairs that are in each other's lists with at least that cosine."""
    flat = near.select("id", F.explode("near").alias("x")).where(F.col("x.cosine") >= least)
    pairs = flat.select(F.least("id", "x.id").alias("id_a"), F.greatest("id", "x.id").alias("id_b"), F.col("x.cosine").alias("cosine"))
    return pairs.groupBy("id_a", "id_b").agg(F.count("*").alias("n"), F.max("cosine").alias("cosine")).where("n = 2").drop("n")
