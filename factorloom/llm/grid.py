"""Clusters of similar vectors by a grid of quantised features, exact for single linkage at a least cosine.

1. Unit vectors are turned to their principal axes, and the first few coordinates are quantised to cells as wide as the distance of two linked vectors,
   so linked vectors lie in the same cell or in adjacent ones. Rows of each cell are counted.
2. Block by block, densest cells first, a vector that is linked to many others is made a node that stands for all of them (a dense part of its cell);
   vectors with few links are nodes of their own. Every row now hangs on a node by a link. Nodes of all blocks are taken together, in order of their cells,
   and a dense node takes up the nodes linked to it, until there are no more dense nodes than fit a block: their number follows the space, not the rows.
3. Cells are joined with their adjacent cells; nodes of joined cells are linked where their vectors are.
4. Minimum labels are propagated along the links to convergence, in SQL, with pointer jumping.
5. What is left is to see whether two components touch in rows that aren't nodes. For two dense components, rows are projected on the line between
   their centres; only rows within a link's reach of the other's outermost row can matter, and those are compared in blocks. For single nodes,
   the cone around the centre of a component tells which can reach it. Links found are added and labels propagated again.

Nothing is sampled; axes, thresholds and sizes of blocks change the work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import matrix
from ..session import forget, write_table
from .runs import top_per_group

#: Quantised axes; rows of a block in which nodes are chosen; links that make a node dense; rows of a node block; single nodes and pairs of centres of a round.
AXES, BLOCK, DENSE, PIECE, ROUND = 4, 32_768, 16, 8192, 50_000
#: Single nodes that ask components up to which they are sent to all tasks.
SINGLES = 50_000
#: Members that stream past one piece of the nodes that ask them.
STREAM = 1_000_000
#: Dense nodes up to which their labels are sent to all tasks (16 bytes each).
SMALL_NODES = 500_000
#: Dense components up to which their centres are held by every task; beyond, denser nodes are asked for.
CENTRES = 4096
ADD = 1e-5
POINTS = "side string, id bigint, features array<float>, cell bigint, node bigint, dense boolean"


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def axes_of(df: DataFrame, count: int) -> np.ndarray:
    """The first principal axes [count, k] of the unit vectors of a table; the identity's for an empty one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                u = _unit(matrix(b.column(0)))
                total = u.T @ u + (0 if total is None else total)
        if total is not None:
            r, c = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[r, c])], ["r", "c", "v"])

    cells = df.select("features").mapInArrow(partial, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v")).toArrow()
    if not cells.num_rows:
        return np.eye(count)
    r, c, v = (cells.column(k).to_numpy() for k in range(3))
    gram = np.zeros((r.max() + 1, r.max() + 1))
    gram[r, c] = gram[c, r] = v
    return np.linalg.eigh(gram)[1][:, ::-1][:, :count].T


def pack(cells: np.ndarray) -> np.ndarray:
    """Cells [n, axes] as numbers: ten bits an axis."""
    return ((cells.astype(np.int64) + 512) << (10 * np.arange(cells.shape[1], dtype=np.int64))).sum(axis=1)


def nodes_of(u: np.ndarray, cell: np.ndarray, least: float, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """(row that stands for each row, whether it is dense) of a block of unit rows."""
    n = len(u)
    _, inverse, count = np.unique(cell, return_inverse=True, return_counts=True)
    rest = np.lexsort((np.arange(n), cell, -count[inverse]))  # rows of the densest cells first
    stands, is_dense = np.arange(n), np.zeros(n, bool)
    v = u[rest].astype(np.float32)
    while len(rest):
        linked = v @ v[0] >= least + ADD
        linked[0] = True
        if linked.sum() >= dense:
            stands[rest[linked]] = rest[0]
            is_dense[rest[linked]] = True
        else:
            linked[:] = False
            linked[0] = True
        rest, v = rest[~linked], v[~linked]
    return stands, is_dense


def points(vectors: DataFrame, axes: np.ndarray, least: float, dense: int) -> DataFrame:
    """The rows with cell and node; a node's number is unique, the row that has ``id`` and ``node`` of the same is not needed for it."""
    width = float(np.sqrt(2 - 2 * least)) + ADD

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 38
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def flush(side: str) -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held.pop(side)).combine_chunks()
            u = _unit(matrix(t.column("features")))
            cell = pack(np.floor(u @ axes.T / width))
            stands, is_dense = nodes_of(u, cell, least, dense)
            node = stands + made
            lead = stands == np.arange(len(u))
            made += len(u)
            sizes[side] = 0
            return pa.RecordBatch.from_arrays([t.column("side").combine_chunks(), t.column("id").combine_chunks(), t.column("features").combine_chunks(), pa.array(cell), pa.array(node), pa.array(is_dense), pa.array(lead)], ["side", "id", "features", "cell", "node", "dense", "lead"])

        for b in batches:
            names = b.column(0).to_pylist()
            for side in sorted(set(names)):
                part = b.filter(pa.array([x == side for x in names]))
                held.setdefault(side, []).append(part)
                sizes[side] = sizes.get(side, 0) + part.num_rows
                if sizes[side] >= BLOCK:
                    yield flush(side)
        for side in list(held):
            yield flush(side)

    return vectors.select("side", "id", "features").mapInArrow(place, POINTS + ", lead boolean")


def taken_up(u: np.ndarray, dense: np.ndarray, least: float) -> np.ndarray:
    """The row that stands for each row: a dense one stands for all that are linked to it and aren't spoken for."""
    stands, rest = np.arange(len(u)), np.arange(len(u))
    v = u.astype(np.float32)
    for head in np.flatnonzero(dense):
        if stands[head] != head:
            continue
        linked = v[rest] @ v[head] >= least + ADD
        stands[rest[linked]] = head
        rest = rest[~linked]
    return stands


def heads_of(found: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """((side, node, cell, features, dense) of the nodes that stand, (node, top) of those that were taken up) of the nodes of all blocks."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            side = np.array(t.column("side").to_pylist())
            for name in np.unique(side):
                part = t.filter(pa.array(side == name)).combine_chunks()
                stands = taken_up(_unit(matrix(part.column("features"))), part.column("dense").to_numpy(zero_copy_only=False), least)
                node = part.column("node").to_numpy()
                yield from part.append_column("top", pa.array(node[stands])).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= BLOCK:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    heads, ups = found, None
    many = heads.where("dense").count()
    while many:
        parts = max(1, -(-heads.count() // BLOCK))
        step = write_table(heads.repartitionByRange(parts, "side", "cell", "node").mapInArrow(take, "side string, node bigint, cell bigint, features array<float>, dense boolean, top bigint"), "heads")
        up = step.where("node != top").select("node", "top")
        if ups is not None:  # those taken up before follow the node that took them
            then = up.select(F.col("node").alias("top"), F.col("top").alias("_top"))
            up = up.unionByName(ups.join(then, "top", "left").select("node", F.coalesce("_top", "top").alias("top")))
        ups = write_table(up, "ups")
        heads = step.where("node = top").drop("top")
        left = heads.where("dense").count()
        if left <= BLOCK or left > 0.9 * many:
            if parts == 1 or left > 0.9 * many:
                break
        many = left
    return heads, ups if ups is not None else found.where("false").select("node", F.col("node").alias("top"))


def neighbour_cells(cells: DataFrame, axes: int) -> DataFrame:
    """(side, a, b), a <= b: pairs of occupied cells that are the same or adjacent on every axis. Cells: side, cell; at most some for each of axes."""
    part = lambda c, k: F.shiftright(c, 10 * k).bitwiseAND(F.lit(1023)).cast("int")
    first = min(2, axes)
    left = cells.select("side", F.col("cell").alias("a"), *[part(F.col("cell"), k).alias(f"x{k}") for k in range(axes)])
    right = cells.select("side", F.col("cell").alias("b"), *[part(F.col("cell"), k).alias(f"y{k}") for k in range(axes)])
    for k in range(first):
        right = right.withColumn(f"x{k}", F.explode(F.array(*[F.col(f"y{k}") + d for d in (-1, 0, 1)])))
    pairs = left.join(right, ["side", *[f"x{k}" for k in range(first)]]).where("a <= b")
    for k in range(first, axes):
        pairs = pairs.where(F.abs(F.col(f"x{k}") - F.col(f"y{k}")) <= 1)
    return pairs.select("side", "a", "b")


def forest(a: np.ndarray, b: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of links (positions in a and b, in pieces) those of a spanning forest, as pairs of names."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for i, j in links:
        for x, y in zip(a[i].tolist(), b[j].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[rx] = ry
                out.append((x, y))
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def block_links(left: DataFrame, right: DataFrame, keys: list[str], least: float, any_one: bool) -> DataFrame:
    """(a, b): links between nodes of two tables (keys, node, features) that agree in the keys; a spanning forest of them, or with any_one the first found of each key."""

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return _edges([])
        a, b = x.column("node").to_numpy(), y.column("node").to_numpy()
        u, v = _unit(matrix(x.column("features"))), _unit(matrix(y.column("features")))

        def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(u), 512):
                i, j = np.nonzero(u[at : at + 512] @ v.T >= least)
                if any_one and len(i):
                    yield i[:1] + at, j[:1]
                    return
                yield i + at, j

        return _edges(forest(a, b, links()))

    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # names of its own, as both may stem from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of every node that has an edge. Minimum labels are propagated until none changes, then jump to the label of their label."""
    both = edges.where("a != b")
    both = write_table(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    at = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        moved = write_table(step.join(jump, "label", "left").select("node", "_old", F.least("label", F.coalesce("_far", "label")).alias("label")), "labels")
        forget(edges.sparkSession, at)
        at, labels = moved, moved.select("node", "label")
        if moved.where("label != _old").isEmpty():
            return labels


def _by_label(label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(label, kind="stable")
    names, start = np.unique(label[order], return_index=True)
    for name, at in zip(names.tolist(), np.split(order, start[1:])):
        yield name, at


def touching(members: DataFrame, single: DataFrame, least: float) -> DataFrame | None:
    """(a, b): links between dense components (members: side, label, features), and between them and single nodes (single: side, node, label, features) of the same side, as far as
    they decide whether two components are one. None if there are too many dense components to hold their centres."""
    spark = members.sparkSession
    reach = float(np.sqrt(2 - 2 * least)) + ADD

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        kind: dict[int, str] = {}
        for b in batches:
            if b.num_rows:
                u = _unit(matrix(b.column(1)))
                for name, at in _by_label(b.column(0).to_numpy()):
                    total[name] = total.get(name, 0) + u[at].sum(axis=0)
                    kind[name] = b.column(2)[int(at[0])].as_py()
        if total:
            names = list(total)
            v = np.stack([total[x] for x in names])
            r, c = np.indices(v.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[r.ravel()]), pa.array(c.ravel().astype(np.int32)), pa.array(v.ravel()), pa.array([kind[names[k]] for k in r.ravel()])], ["label", "pos", "v", "side"])

    parts = write_table(members.select("label", "features", "side").mapInArrow(sums, "label bigint, pos int, v double, side string").groupBy("label", "pos").agg(F.sum("v").alias("v"), F.first("side").alias("side")), "centres")
    if parts.select("label").distinct().limit(CENTRES + 1).count() > CENTRES:
        return None
    found = parts.orderBy("label", "pos").toArrow()
    if not found.num_rows:
        return spark.createDataFrame([], "a bigint, b bigint")
    names = np.unique(found.column("label").to_numpy())
    centres = _unit(found.column("v").to_numpy().reshape(len(names), -1))
    sides = np.array(found.column("side").to_pylist()).reshape(len(names), -1)[:, 0]
    place = {int(x): i for i, x in enumerate(names)}
    # The widest angle of a member to its centre, and for pairs the outermost projections on the line between the centres.
    cos = np.clip(centres @ centres.T, -1, 1)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, float] = {}
        for b in batches:
            if b.num_rows:
                u = _unit(matrix(b.column(1)))
                for name, at in _by_label(b.column(0).to_numpy()):
                    low[name] = min(low.get(name, 1.0), float((u[at] @ centres[place[name]]).min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array(list(low.values()), pa.float64())], ["label", "low"])

    theta = np.zeros(len(names))
    for r in members.select("label", "features").mapInArrow(widest, "label bigint, low double").groupBy("label").agg(F.min("low").alias("low")).collect():
        theta[place[r.label]] = np.arccos(np.clip(r.low, -1, 1))
    link = float(np.arccos(least)) + ADD
    i, j = np.nonzero(np.triu((np.arccos(cos) <= theta[:, None] + theta[None] + link) & (sides[:, None] == sides[None]), 1))
    edges = spark.createDataFrame([], "a bigint, b bigint")
    for at in range(0, len(i), ROUND):
        edges = edges.unionByName(_pairs(members, names, place, centres, i[at : at + ROUND], j[at : at + ROUND], reach, least))
    edges = edges.unionByName(_singles(members, single, names, sides, centres, theta, link, least))
    return edges


def _pairs(members: DataFrame, names: np.ndarray, place: dict, centres: np.ndarray, i: np.ndarray, j: np.ndarray, reach: float, least: float) -> DataFrame:
    spark = members.sparkSession
    line = centres[i] - centres[j]
    flat = np.linalg.norm(line, axis=1, keepdims=True)
    line = np.where(flat > 1e-9, line / np.where(flat > 1e-9, flat, 1), centres[i])
    mine = {c: (np.flatnonzero(i == c), np.flatnonzero(j == c)) for c in {*i.tolist(), *j.tolist()}}

    def outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(len(i), np.inf), np.full(len(i), -np.inf)
        for b in batches:
            if b.num_rows:
                u = _unit(matrix(b.column(1)))
                for name, at in _by_label(b.column(0).to_numpy()):
                    for side, pairs in enumerate(mine.get(place[name], ([], []))):
                        if len(pairs):
                            t = u[at] @ line[pairs].T
                            if side == 0:
                                lo[pairs] = np.minimum(lo[pairs], t.min(axis=0))
                            else:
                                hi[pairs] = np.maximum(hi[pairs], t.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i), dtype=np.int32)), pa.array(lo), pa.array(hi)], ["pair", "lo", "hi"])

    lo, hi = np.full(len(i), np.inf), np.full(len(i), -np.inf)
    for r in members.select("label", "features").mapInArrow(outermost, "pair int, lo double, hi double").groupBy("pair").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        lo[r.pair], hi[r.pair] = r.lo, r.hi
    near = lo - hi <= reach
    if not near.any():
        return spark.createDataFrame([], "a bigint, b bigint")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(matrix(b.column(1)))
            for name, at in _by_label(b.column(0).to_numpy()):
                for side, pairs in enumerate(mine.get(place[name], ([], []))):
                    for p in (x for x in pairs if near[x]):
                        t = u[at] @ line[p]
                        keep = at[t <= hi[p] + reach] if side == 0 else at[t >= lo[p] - reach]
                        if len(keep):
                            n = len(keep)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(np.full(n, name)), b.column(1).take(pa.array(keep))], ["pair", "side", "node", "features"])

    rows = write_table(members.select("label", "features").mapInArrow(within, "pair int, side int, node bigint, features array<float>"), "border")
    sizes = rows.groupBy("pair").pivot("side", [0, 1]).count().select("pair", *[F.ceil(F.coalesce(F.col(s), F.lit(0)) / PIECE).cast("int").alias(f"n{s}") for s in ("0", "1")]).where("n0 > 0 and n1 > 0")
    piece = lambda n: F.pmod(F.xxhash64("features"), F.col(n)).cast("int")
    split = rows.join(sizes, "pair")
    left = split.where("side = 0").withColumn("p0", piece("n0")).withColumn("p1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)))
    right = split.where("side = 1").withColumn("p1", piece("n1")).withColumn("p0", F.explode(F.sequence(F.lit(0), F.col("n0") - 1)))
    cols = ["pair", "p0", "p1", "node", "features"]
    return write_table(block_links(left.select(*cols), right.select(*cols), ["pair", "p0", "p1"], least, True), "edges")


def _singles(members: DataFrame, single: DataFrame, names: np.ndarray, sides: np.ndarray, centres: np.ndarray, theta: np.ndarray, link: float, least: float) -> DataFrame:
    spark = members.sparkSession

    def cone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _unit(matrix(b.column(2)))
                ask = np.arccos(np.clip(u @ centres.T, -1, 1)) <= theta + link
                ask &= names[None] != b.column(1).to_numpy()[:, None]
                ask &= sides[None] == np.array(b.column(3).to_pylist())[:, None]
                r, c = np.nonzero(ask)
                if len(r):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(names[c]), b.column(2).take(pa.array(r))], ["node", "label", "features"])

    asks = write_table(single.select("node", "label", "features", "side").mapInArrow(cone, "node bigint, label bigint, features array<float>"), "cone")
    if asks.limit(SINGLES + 1).count() > SINGLES:
        return _met(asks, members, least)
    part = asks.toArrow()
    label, node, v = part.column("label").to_numpy(), part.column("node").to_numpy(), _unit(matrix(part.column("features"), centres.shape[1])) if part.num_rows else np.zeros((0, centres.shape[1]))
    shared = spark.sparkContext.broadcast({name: (node[at], v[at]) for name, at in _by_label(label)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for b in batches:
            if b.num_rows:
                u = _unit(matrix(b.column(1)))
                for name, at in _by_label(b.column(0).to_numpy()):
                    if name in shared.value:
                        nodes, w = shared.value[name]
                        met.update((int(x), name) for x in nodes[(u[at] @ w.T).max(axis=0) >= least])
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in met], pa.int64()), pa.array([m[1] for m in met], pa.int64())], ["a", "b"])

    return members.select("label", "features").mapInArrow(meet, "a bigint, b bigint").distinct()


def _met(asks: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(a, b): single nodes and the components that have a member linked to them, of (node, label, features) and (label, features): members stream past the
    nodes that ask their component, both cut into pieces."""
    some = asks.groupBy("label").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    size = members.groupBy("label").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("parts")).join(some, "label")
    size = write_table(size, "asked")  # one row a component, at most CENTRES
    part = F.pmod(F.xxhash64("features"), F.col("parts")).cast("int")
    left = asks.join(F.broadcast(size), "label").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = members.join(F.broadcast(size), "label").withColumn("part", part).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cols = ["label", "piece", "part", "role", "node", "features"]
    both = left.withColumn("role", F.lit(0)).select(*cols).unionByName(right.withColumns({"role": F.lit(1), "node": F.lit(0).cast("bigint")}).select(*cols))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, nodes, w, met = None, [], None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(4)])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
            for lo, hi in zip(cuts, cuts[1:]):
                name, rows = tuple(key[:3, lo]), b.slice(lo, hi - lo)
                if key[3, lo] == 0:
                    if name != at:
                        at, held = name, []
                    held.append(rows)
                    w = None
                    continue
                if name != at:
                    continue
                if w is None:
                    t = pa.Table.from_batches(held)
                    nodes, w, met = t.column("node").to_numpy(), _unit(matrix(t.column("features"))), np.zeros(t.num_rows, bool)
                u = _unit(matrix(rows.column(5)))
                new = ((u @ w.T) >= least).any(axis=0) & ~met
                met |= new
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(np.full(int(new.sum()), name[0]))], ["a", "b"])

    return both.repartition("label", "piece", "part").sortWithinPartitions("label", "piece", "part", "role").mapInArrow(stream, "a bigint, b bigint").distinct()


def cluster(vectors: DataFrame, least: float = 0.8, smallest: int = 5, axes: int = AXES, dense: int = DENSE, fit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((side, id, root_id) of the members of all clusters, (side, id, cell, features, root_id) for reports).

    vectors: side (kinds that are clustered apart), id (unique in its side), features (usable ones of one length). Two ids are in one cluster if their
    cosine is at least ``least``, directly or by way of others; clusters of fewer than ``smallest`` ids are left out. root_id is the smallest id of the
    cluster. Equal vectors are linked like others. An empty table gives an empty one. ``fit``: rows to find the axes from (features), if another table than
    ``vectors`` is cheaper to read; axes decide about the work, not about the result.
    """
    turned = axes_of(vectors if fit is None else fit, axes)
    rows = write_table(points(vectors, turned, least, dense), "points")
    nodes, ups = heads_of(rows.where("lead").select("side", "node", "cell", "features", "dense"), least)
    nodes = write_table(nodes, "nodes")
    tops = nodes.select("node", F.col("node").alias("top")).unionByName(ups)  # of the nodes of all blocks
    cells = write_table(nodes.groupBy("side", "cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")), "cells")
    pairs = neighbour_cells(cells, axes)
    pa_, pb = (cells.select("side", F.col("cell").alias(c), F.col("pieces").alias(f"n{c}")) for c in "ab")
    pairs = pairs.join(pa_, ["side", "a"]).join(pb, ["side", "b"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = write_table(pairs.where("a < b or x <= y").select("side", "a", "x", "b", "y"), "pairs")
    pieced = nodes.join(cells, ["side", "cell"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    keys = ["side", "a", "x", "b", "y"]
    left = pieced.select("side", F.col("cell").alias("a"), F.col("piece").alias("x"), "node", "features").join(pairs, ["side", "a", "x"]).select(*keys, "node", "features")
    right = pieced.select("side", F.col("cell").alias("b"), F.col("piece").alias("y"), "node", "features").join(pairs, ["side", "b", "y"]).select(*keys, "node", "features")
    edges = write_table(block_links(left, right, keys, least, False).where("a != b"), "links")
    labels = components(edges)

    labelled = nodes.join(labels, "node", "left").select("side", "node", "features", "dense", F.coalesce("label", "node").alias("label"))
    heads = labelled.where("dense").select("node", "label")
    names = write_table(tops.join(heads.withColumnRenamed("node", "top"), "top").select("node", "label"), "dense")
    members = rows.select("side", "node", "features")
    if names.limit(SMALL_NODES + 1).count() <= SMALL_NODES:  # every pass over the members joins them without a shuffle
        members = members.join(F.broadcast(names), "node").select("side", "label", "features")
    else:
        members = write_table(members.join(names, "node").select("side", "label", "features"), "members")
    single = labelled.where("not dense").select("side", "node", "label", "features")
    more = touching(members, single, least)
    if more is None:
        return cluster(vectors, least, smallest, axes, dense * 4, fit)
    joined = single.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(heads.select(F.col("node").alias("a"), F.col("label").alias("b"))).where("a != b")
    more = write_table(more, "touching")
    if not more.isEmpty():
        labels = components(joined.unionByName(more))
    of_node = tops.join(labels.withColumnRenamed("node", "top"), "top", "left").select("node", F.coalesce("label", "top").alias("label"))
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    whole = of_node.join(sizes, "node").withColumn("_", F.lit(0))
    roots = whole.groupBy("label").agg(F.sum("n").alias("n"), F.min("least").alias("root_id")).where(F.col("n") >= smallest)
    to = of_node.join(roots.select("label", "root_id"), "label").select("node", "root_id")
    out = rows.select("side", "id", "cell", "features", "node").join(to, "node").drop("node")
    return out.select("side", "root_id", "id"), out


def describe(members: DataFrame, typical: int = 5) -> DataFrame:
    """(side, root_id, size, n_cells, cell_rows, typical): of each cluster its size, the number of its cells, the rows of the densest one, and that cell's members nearest to its mean, ties by smaller id."""
    per_cell = members.groupBy("side", "root_id", "cell").agg(F.count("*").alias("n"))
    sizes = per_cell.groupBy("side", "root_id").agg(F.sum("n").alias("size"), F.count("*").alias("n_cells"), F.max(F.struct("n", F.col("cell"))).alias("best"))
    sizes = sizes.select("side", "root_id", "size", "n_cells", F.col("best.n").alias("cell_rows"), F.col("best.cell").alias("cell"))
    dense = members.join(sizes.select("side", "root_id", "cell"), ["side", "root_id", "cell"])
    norm = F.sqrt(F.aggregate(F.transform("features", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    mean = dense.select("side", "root_id", F.posexplode("features").alias("pos", "v"), norm.alias("_n")).groupBy("side", "root_id", "pos").agg(F.avg(F.col("v") / F.col("_n")).alias("v"))
    mean = mean.groupBy("side", "root_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("mean"))
    near = F.aggregate(F.zip_with("features", "mean", lambda x, m: x.cast("double") * m), F.lit(0.0), lambda s, x: s + x) / norm
    scored = dense.join(mean, ["side", "root_id"]).select(F.xxhash64("side", "root_id").alias("g"), "id", F.round(near, 9).alias("s"))
    best = top_per_group(scored, "g", "s", "id", typical).groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("typical"))
    return sizes.withColumn("g", F.xxhash64("side", "root_id")).join(best, "g").select("side", "root_id", "size", "n_cells", "cell_rows", "typical")
