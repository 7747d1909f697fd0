"""Implicit-feedback alternating least squares.

A half-step solves one side from the other: W = G + sum alpha*|r| y y' + lambda'*n*I and b = sum over r > 0 of (1 + alpha*|r|) y, x = W^-1 b, with
G the Gramian of all vectors of the other side and lambda' = alpha*lambda. Rows of many entries are cut into fragments of bounded size whose
normal equations are added, so no task ever holds all entries of one row. Fragments are gathered in blocks that are packed once. Factors that fit a broadcast
are sent to every executor; else each is sent once to each block that needs it: a half-step moves distinct (block, column) pairs, not one vector an entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions.linalg import full_rank, gramian, lists, matrix
from ..functions.vectors import dot
from ..session import BROADCAST_BYTES, forget, write_table
from .initial import initial_y

#: Entries of a row that one fragment may hold, and of a block, which a task holds with the factors it needs.
FRAGMENT, BLOCK = 4096, 262_144
#: Numbers of the outer products that are added at a time.
CHUNK = 1 << 22
#: Rows of a table of long rows up to which it is sent to every executor (16 bytes each).
SMALL_ROWS = 1_000_000


def ratings_by(prefs: DataFrame, by: str, of: str, fragment: int = FRAGMENT, block: int = BLOCK) -> DataFrame:
    """(row, col, value, n, frag, block): entries of one side's rows; n and the fragment of the entry for rows of more than ``fragment`` entries, null and 0 for others.

    All entries of a fragment are in one block, blocks have about equally many. Built once, used by every iteration."""
    entries = prefs.select(F.col(by).alias("row"), F.col(of).alias("col"), F.col("value").cast("double").alias("value")).where("row is not null and col is not null and value is not null")
    sizes = entries.groupBy("row").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > fragment).alias("long")).first()
    if total.long:
        long = sizes.where(F.col("n") > fragment)
        entries = entries.join(F.broadcast(long) if total.long <= SMALL_ROWS else long, "row", "left")
    else:
        entries = entries.withColumn("n", F.lit(None).cast("bigint"))
    pieces = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(fragment)).cast("int")
    blocks = max(prefs.sparkSession.sparkContext.defaultParallelism, -(-(total.n or 0) // block))
    out = entries.withColumn("frag", F.pmod(F.xxhash64("col"), pieces).cast("int"))
    out = out.withColumn("block", F.pmod(F.xxhash64("row", "frag"), F.lit(blocks)).cast("int"))
    out._factorloom_blocks = blocks
    return out


def pack(ratings: DataFrame) -> DataFrame:
    """One row for each block of ``ratings_by``, as bytes of numpy arrays: cols, the ids it needs, ascending; at, value: the place of an entry's id in them, its
    value, by row; rows, starts, n: ids of its rows, where their entries begin, entries of a long row in all blocks and -1 for others. long: it has such rows."""
    blocks = getattr(ratings, "_factorloom_blocks", None) or (ratings.agg(F.max("block")).first()[0] or 0) + 1
    names = ["block", "cols", "at", "value", "rows", "starts", "n", "long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        block, row, col, value, frag = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(5))
        n = np.concatenate([b.column(5).fill_null(-1).to_numpy(zero_copy_only=False) for b in batches])
        cols, at = np.unique(col, return_inverse=True)
        by = np.lexsort((at, frag, row))
        row, n = row[by], n[by]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        arrays = (cols, at[by].astype(np.int32), value[by], row[starts], starts.astype(np.int32), n[starts])
        yield pa.RecordBatch.from_arrays([pa.array(block[:1], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays], pa.array([bool((n >= 0).any())])], names)

    each = ratings.select("block", "row", "col", "value", "frag", "n").repartitionById(blocks, "block")  # a task, and a file, for each block
    return each.mapInArrow(run, "block int, cols binary, at binary, value binary, rows binary, starts binary, n binary, long boolean")


def needs_of(ratings: DataFrame) -> DataFrame:
    """(block, col): the ids whose factors a block needs, each once."""
    if "cols" not in ratings.columns:
        return ratings.select("block", "col").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, cols in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(cols, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block, np.int32)), pa.array(ids)], ["block", "col"])

    return ratings.select("block", "cols").mapInArrow(run, "block int, col bigint")


def _sums(y: np.ndarray, at: np.ndarray, weight: np.ndarray, target: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sum of weight * y y', sum of target * y) for some of the rows at a time, those of one size; ``at``: the vector of each entry, ``start``: where rows begin."""
    k, size = y.shape[1], np.diff(np.append(start, len(at)))
    order = np.argsort(size, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(size[order], prepend=-1)), len(order))
    for lo, hi in zip(cuts, cuts[1:]):
        n = int(size[order[lo]])
        step = max(1, CHUNK // (k * (k + 2 * n)))
        for a in range(lo, hi, step):
            rows = order[a : min(a + step, hi)]
            pick = start[rows][:, None] + np.arange(n)
            part = y[at[pick]]
            yield rows, (part * weight[pick][..., None]).transpose(0, 2, 1) @ part, (target[pick][:, None] @ part)[:, 0]


def _local(factors: DataFrame, k: int, limit_bytes: int, rows: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids ascending, vectors) of a factor table that takes ``limit_bytes`` at most, else None."""
    wide = 4 if factors.schema["features"].dataType.elementType == T.FloatType() else 8
    if (factors.count() if rows is None else rows) * (wide * k + 8) > limit_bytes:
        return None
    t = factors.select("id", "features").toArrow()
    ids = t.column("id").to_numpy()
    order = np.argsort(ids)
    return ids[order], matrix(t.column("features"), k, np.float32 if wide == 4 else np.float64)[order]


def half_step(ratings: DataFrame, factors: DataFrame, settings: Settings, gram: np.ndarray | None = None, needs: DataFrame | None = None, limit_bytes: int = BROADCAST_BYTES, long: bool | None = None, rows: int | None = None) -> DataFrame:
    """(id, features DOUBLE[]) of one side, from ``ratings_by``, packed or not, and the other side's (id, features).

    Factors of up to ``limit_bytes`` are sent to every executor. Beyond that a factor travels once to each block that needs it (``needs``, found from the ratings
    if not given), not to every entry. Ids without a factor on the other side make the result fail rather than be joined away. ``long``: rows of several
    fragments exist; ``rows``: how many factors there are; both are looked up if not given."""
    k, alpha, lam = settings.features, settings.alpha, settings.effective_lambda
    rebuild, observed = settings.reconstruct_r, settings.loss_ignores_unspecified
    spark = ratings.sparkSession
    packed = ratings if "cols" in ratings.columns else write_table(pack(ratings), "packed")
    local = _local(factors, k, limit_bytes, rows)
    if observed:
        gram = np.zeros((k, k))
    elif gram is None and local is None:
        gram = gramian(factors, "features", k)
    elif gram is None:
        gram = sum((m.T @ m for a in range(0, len(local[1]), 1 << 16) for m in [local[1][a : a + (1 << 16)].astype(np.float64)]), np.zeros((k, k)))
    names = ["id", "n", "features", "part"]
    schema = "id bigint, n bigint, features array<double>, part array<double>"
    lists_of = pa.list_(pa.float64())

    def equations(p: dict, ids: np.ndarray, m: np.ndarray) -> list[pa.Array]:
        cols, at, value, row, start, n = (np.frombuffer(p[c], t) for c, t in (("cols", np.int64), ("at", np.int32), ("value", np.float64), ("rows", np.int64), ("starts", np.int32), ("n", np.int64)))
        place = np.searchsorted(ids, cols)
        found = (ids[np.minimum(place, len(ids) - 1)] == cols) if len(ids) else np.zeros(len(cols), bool)
        if not found.all():
            raise ValueError(f"no factor for id {cols[~found][0]}")
        y = m[place].astype(np.float64, copy=False)
        if rebuild:
            weight, target = np.full(len(value), 1.0 if observed else 0.0), value
        else:
            conf = alpha * np.abs(value)
            weight, target = conf + 1.0 if observed else conf, (value > 0) * (1.0 + conf)
        size = np.diff(np.append(start, len(value)))
        solved, part = np.zeros((len(row), k)), [None] * len(row)
        for rows, w, rhs in _sums(y, at, weight, target, start):
            whole = n[rows] < 0
            if whole.all():
                solved[rows] = np.linalg.solve(w + gram + (lam * size[rows])[:, None, None] * np.eye(k), rhs[..., None])[..., 0]
                continue
            if whole.any():
                solved[rows[whole]] = np.linalg.solve(w[whole] + gram + (lam * size[rows[whole]])[:, None, None] * np.eye(k), rhs[whole][..., None])[..., 0]
            for i in np.flatnonzero(~whole):
                part[rows[i]] = np.concatenate([w[i].ravel(), rhs[i]])
        return [pa.array(row), pa.array(n, mask=n < 0), lists(solved), pa.array(part, lists_of)]

    if local is not None:
        shared = spark.sparkContext.broadcast(local)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    yield pa.RecordBatch.from_arrays(equations({c: b.column(c)[i].as_py() for c in b.schema.names}, *shared.value), names)

        out = packed.mapInArrow(run, schema)
        out._factorloom_sent = shared
    else:

        def joined(key: tuple, e: pa.Table, f: pa.Table) -> pa.Table:
            if not e.num_rows:
                return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), lists_of, lists_of))})
            ids = f.column("col").to_numpy()
            order = np.argsort(ids)
            return pa.table(equations({c: e.column(c)[0].as_py() for c in e.column_names}, ids[order], matrix(f.column("features"), k, f.schema.field("features").type.value_type.to_pandas_dtype())[order]), names=names)

        wanted = needs_of(packed) if needs is None else needs
        sent = wanted.join(factors.select(F.col("id").alias("col"), "features"), "col").select("block", "col", "features")
        entries = packed.select(*[F.col(c).alias(c) for c in packed.columns])  # names of its own, as both stem from one table
        out = entries.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(joined, T._parse_datatype_string(schema))
    if not (bool(packed.where("long").take(1)) if long is None else long):
        few = out.select("id", "features")
        few._factorloom_sent = getattr(out, "_factorloom_sent", None)
        return few
    out = write_table(out, "half")  # read for whole rows and for parts of long ones

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, total = None, 0, None

            def flush() -> pa.RecordBatch:
                if not last:
                    return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([n]), pa.array([total], lists_of)], ["id", "n", "part"])
                w = total[: k * k].reshape(k, k) + gram + lam * n * np.eye(k)
                return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([np.linalg.solve(w, total[k * k :])], lists_of)], ["id", "features"])

            for b in batches:
                for i, (row, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    if total is not None and row != held:
                        yield flush()
                        total = None
                    v = b.column(2)[i].values.to_numpy()
                    held, n, total = row, size, v.copy() if total is None else total + v
            if total is not None:
                yield flush()

        return run

    parts = out.where("part is not null").select("id", "n", "part")  # one for each block that has some of a long row
    once = parts.repartition("id", F.spark_partition_id() % 16).sortWithinPartitions("id").mapInArrow(add(False), "id bigint, n bigint, part array<double>")
    whole = once.repartition("id").sortWithinPartitions("id").mapInArrow(add(True), "id bigint, features array<double>")
    return out.where("part is null").select("id", "features").unionByName(whole)


def normal_equations(ratings: DataFrame, factors: DataFrame, settings: Settings) -> DataFrame:
    """(id, r, c, v): the cells of W, and those of b at c = k, of every row, as plain sums in the JVM. For inspection and small k; ``half_step`` is the fast way."""
    k, alpha, lam = settings.features, settings.alpha, settings.effective_lambda
    gram = np.zeros((k, k)) if settings.loss_ignores_unspecified else gramian(factors, "features", k)
    y = factors.select(F.col("id").alias("col"), F.col("features").cast("array<double>").alias("y"))
    sizes = ratings.groupBy("row").agg(F.count("*").alias("n"))
    e = ratings.drop("n").join(sizes, "row").join(y, "col").withColumn("conf", F.lit(alpha) * F.abs("value"))
    weight = F.lit(0.0) if settings.reconstruct_r else F.col("conf")
    weight = weight + F.lit(1.0) if settings.loss_ignores_unspecified else weight
    target = F.col("value") if settings.reconstruct_r else F.when(F.col("value") > 0, 1.0 + F.col("conf")).otherwise(0.0)
    cells = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), (weight * F.col("y")[r] * F.col("y")[c] if c < k else target * F.col("y")[r]).alias("v")) for r in range(k) for c in range(k + 1)])
    sums = e.select("row", "n", F.explode(cells).alias("x")).groupBy("row", "n", "x.r", "x.c").agg(F.sum("x.v").alias("v"))
    base = F.coalesce(*[F.when((F.col("r") == r) & (F.col("c") == c), F.lit(float(gram[r, c]))) for r in range(k) for c in range(k)], F.lit(0.0))
    ridge = F.when(F.col("r") == F.col("c"), F.lit(lam) * F.col("n")).otherwise(0.0)
    return sums.select(F.col("row").alias("id"), "r", "c", (F.col("v") + base + ridge).alias("v"))


def convergence_sample(x: DataFrame, y: DataFrame, modulus: int) -> DataFrame:
    """(row_id, col_id, estimate): inner products of the sampled items and users, those whose id is divisible by the modulus.

    Users stay where they are spread, in blocks; the sampled items, 1 / modulus of them, are copied to the blocks."""
    blocks = max(1, x.sparkSession.sparkContext.defaultParallelism)
    rows = y.where(F.col("id") % modulus == 0).select(F.col("id").alias("row_id"), F.col("features").alias("_y"))
    cols = x.where(F.col("id") % modulus == 0).select(F.col("id").alias("col_id"), F.col("features").alias("_x"))
    left = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = cols.withColumn("_block", F.pmod(F.xxhash64("col_id"), F.lit(blocks)).cast("int"))
    return left.join(right, "_block").select("row_id", "col_id", dot(F.col("_y"), F.col("_x")).alias("estimate"))


def convergence_value(now: DataFrame, before: DataFrame) -> DataFrame:
    """(value): mean of abs(change) weighted by the positive part of the new estimate; null if nothing has weight."""
    a = now.select("row_id", "col_id", "estimate")
    b = before.select("row_id", "col_id", F.col("estimate").alias("_before"))
    w = F.greatest(F.col("estimate"), F.lit(0.0))
    return a.join(b, ["row_id", "col_id"]).agg(F.try_divide(F.sum(w * F.abs(F.col("estimate") - F.col("_before"))), F.sum(w)).alias("value"))


def sampled(x: DataFrame, y: DataFrame, modulus: int) -> DataFrame:
    """(side, id, features): the vectors whose products ``convergence_sample`` has. A 1 / modulus of both, while products grow with the square."""
    return x.where(F.col("id") % modulus == 0).select(F.lit("x").alias("side"), "id", "features").unionByName(y.where(F.col("id") % modulus == 0).select(F.lit("y").alias("side"), "id", "features"))


def _sample(df: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    t = df.toArrow()
    out = {}
    for side in "xy":
        part = t.filter(pa.compute.equal(t.column("side"), side))
        ids = part.column("id").to_numpy()
        order = np.argsort(ids)
        out[side] = (ids[order], matrix(part.column("features"))[order])
    return out


def _change(spark, now: dict, before: dict) -> float | None:
    """The ``convergence_value`` of two samples of vectors; products are added up as they are made, on the executors if they are many."""
    (xi, x, x0), (yi, y, y0) = ((ids, now[s][1][a], before[s][1][b]) for s in "xy" for ids, a, b in [np.intersect1d(now[s][0], before[s][0], assume_unique=True, return_indices=True)])
    if not len(xi) or not len(yi):
        return None

    def sums(lo: int, hi: int, x: np.ndarray, x0: np.ndarray, y: np.ndarray, y0: np.ndarray) -> np.ndarray:
        out, step = np.zeros(2), max(1, CHUNK // len(y))
        with np.errstate(all="ignore"):
            for a in range(lo, hi, step):
                e = x[a : min(a + step, hi)] @ y.T
                w = np.maximum(e, 0.0)
                out += [(w * np.abs(e - x0[a : min(a + step, hi)] @ y0.T)).sum(), w.sum()]
        return out

    if len(xi) * len(yi) <= CHUNK * 4:
        total = sums(0, len(xi), x, x0, y, y0)
    else:
        shared = spark.sparkContext.broadcast((x, x0, y, y0))
        step = max(1, CHUNK // len(yi))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in b.column(0).to_pylist():
                    s = sums(at, min(at + step, len(xi)), *shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(s[:1]), pa.array(s[1:])], ["change", "weight"])

        parts = spark.range(0, len(xi), step).mapInArrow(run, "change double, weight double").toArrow()
        total = np.array([parts.column(c).to_numpy().sum() for c in ("change", "weight")])
        shared.unpersist()
    return float(total[0] / total[1]) if total[1] else None


@dataclass
class Model:
    x: DataFrame
    y: DataFrame
    iterations: int
    changes: list[float]
    full_rank: bool


def stop(iteration: int, change: float, settings: Settings) -> bool:
    """Not before iteration 2, unless that is beyond the maximum; at the maximum (0 or less: there is none); when the change isn't finite or below the threshold."""
    if 0 < settings.max_iterations <= iteration:
        return True
    return iteration >= 2 and (not np.isfinite(change) or change < settings.convergence_threshold)


def fit(prefs: DataFrame, settings: Settings, previous_y: DataFrame | None = None, keep=write_table, seed: int = 1, done: int = 0, drop=None, each=None) -> Model:
    """Alternates until the sampled estimates settle. Each half-step is written to the shared folder, so that plans stay short and a lost executor costs one half-step.

    ``keep(df, name)`` writes a step and gives it back read; one that finds steps already written resumes a run, with ``done`` the last whole iteration of it.
    ``drop(name)`` is told which steps of two iterations before are no longer needed. ``each(n, x, y)`` sees the factors of every iteration."""
    mine: dict[str, DataFrame] = {}
    if keep is write_table and drop is None:
        keep = lambda df, name: mine.setdefault(name, write_table(df, name))
        drop = lambda name: forget(prefs.sparkSession, mine.pop(name)) if name in mine else None
    by_user, by_item = (keep(pack(ratings_by(prefs, a, b)), f"packed-{a}") for a, b in (("user_id", "item_id"), ("item_id", "user_id")))
    long = {id(r): bool(r.where("long").take(1)) for r in (by_user, by_item)}
    count: dict[str, int] = {}

    def half(ratings: DataFrame, factors: DataFrame, name: str) -> DataFrame:
        side = "xy"[name[0] == "x"]
        rows = factors.count() if n == 1 else count[side] if side in count else count.setdefault(side, factors.count())  # all iterations but the start have the same rows
        df = half_step(ratings, factors, settings, long=long[id(ratings)], rows=rows)
        out = keep(df.select("id", F.col("features").cast("array<float>").alias("features")), name)
        if getattr(df, "_factorloom_sent", None) is not None:
            df._factorloom_sent.unpersist()
        return out

    y = keep(initial_y(prefs.select("item_id"), previous_y, settings.features, seed), "y-0") if not done else None
    changes: list[float] = []
    sample = None
    n = max(0, done - 2)  # the two last iterations are read again for their change
    while True:
        n += 1
        x = half(by_user, y, f"x-{n}") if n > done else keep(None, f"x-{n}")
        if not settings.iterate:
            break
        y = half(by_item, x, f"y-{n}") if n > done else keep(None, f"y-{n}")
        vectors = sampled(x, y, settings.convergence_modulus)
        now = _sample(vectors if mine else keep(vectors if n > done else None, f"s-{n}"))
        change = 2.0 ** -(n + 1)
        if sample is not None:
            size, last = (len(d["x"][0]) * len(d["y"][0]) for d in (now, sample))
            if size != last:
                raise ValueError(f"the samples of iterations {n - 1} and {n} differ in size")
            value = _change(prefs.sparkSession, now, sample)
            change = change if not size else float("nan") if value is None else value
        sample = now
        changes.append(change)
        if each is not None:
            each(n, x, y)
        if drop is not None and n > 2:
            for side in "xys":
                drop(f"{side}-{n - 2}")
        if n >= done and stop(n, change, settings):
            break
    ok = all(full_rank(gramian(m, "features", settings.features)) for m in (x, y))
    return Model(x, y, n, changes, ok)
