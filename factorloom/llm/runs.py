"""Top N items of every group by merging sorted runs with a loser tree.

Every task sorts its rows by (group, score descending, item) into runs of bounded length and keeps N rows of each group in a run. Runs are stored as a
table. They are read in buckets by the hash of the group, as many as the stored rows need, in order of (group, run): a task holds a bounded number of rows,
cut at a group's end, and merges their runs by a tree of losers; when a group has its N rows, every run is moved to its next group by binary search. A group
with more rows than that is merged in passes, each of which leaves N of them as one run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table

#: Rows of a run before N are kept of each group.
RUN_ROWS = 131_072
#: Rows that a merging task holds, and rows of a bucket.
HELD_ROWS, BUCKET_ROWS = 131_072, 2_000_000
END = (1,)


class LoserTree:
    """The smallest head of k sorted runs; ``next`` replays one path of log2 k matches."""

    def __init__(self, heads: list[tuple]):
        self.k = len(heads)
        self.heads = heads
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if heads[b] < heads[a]:
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if self.k > 1 else 0

    def next(self, head: tuple) -> None:
        """Replaces the head of the winning run."""
        w, losers, heads = self.winner, self.losers, self.heads
        heads[w] = head
        node = (w + self.k) >> 1
        while node:
            other = losers[node]
            if heads[other] < heads[w]:
                losers[node], w = w, other
            node >>= 1
        self.winner = w


def sorted_run(group: np.ndarray, score: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """Positions of the rows of a run in order, at most n of each group."""
    order = np.lexsort((item, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < n]


def merge_runs(group: list, neg: list, item: list, bounds: list[tuple[int, int]], n: int) -> Iterator[tuple]:
    """(group, rank, position) of the first n rows of each group over all runs; runs are the ranges of ``bounds``, each in order of (group, neg, item)."""
    at = [a for a, _ in bounds]
    ends = [b for _, b in bounds]

    def head(r: int) -> tuple:
        p = at[r]
        return (0, group[p], neg[p], item[p]) if p < ends[r] else END

    tree = LoserTree([head(r) for r in range(len(bounds))])
    current, rank = None, 0
    while tree.heads[tree.winner] is not END:
        r = tree.winner
        p = at[r]
        g = group[p]
        if g != current:
            current, rank = g, 0
        if rank < n:
            rank += 1
            yield g, rank, p
            at[r] = p + 1
        else:
            at[r] = bisect_right(group, g, p, ends[r])  # on to the run's next group
        tree.next(head(r))


def merge_block(t: pa.Table, n: int) -> pa.Table:
    """(g, i, s, rank): the first n rows of each group of a block of runs (run, pos, g, s, i), by the tree."""
    run, pos, g, s, i = (t.column(c).to_numpy() for c in ("run", "pos", "g", "s", "i"))
    order = np.lexsort((pos, run))
    run, g, s, i = run[order], g[order], s[order], i[order]
    cuts = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]]).tolist()
    found = list(merge_runs(g.tolist(), (-s).tolist(), i.tolist(), list(zip(cuts, cuts[1:])), n))
    at = np.fromiter((f[2] for f in found), np.int64, len(found))
    rank = np.fromiter((f[1] for f in found), np.int32, len(found))
    return pa.table([pa.array(g[at]), pa.array(i[at]), pa.array(s[at]), pa.array(rank)], names=["g", "i", "s", "rank"])


def merged(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """``merge_block`` over a stream in order of (g, run, pos), holding about HELD_ROWS rows."""
    held: list[pa.RecordBatch | pa.Table] = []
    size, passes = 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < HELD_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        g = t.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
        if cut:
            yield from merge_block(t.slice(0, cut), n).to_batches()
            held = t.slice(cut).combine_chunks().to_batches()
        else:
            passes += 1
            best = merge_block(t, n)
            one = np.full(best.num_rows, -passes)
            held = pa.table([pa.array(one), best.column("rank").cast(pa.int64()), best.column("g"), best.column("s"), best.column("i")], schema=t.schema).combine_chunks().to_batches()
        size = sum(x.num_rows for x in held)
    if held:
        yield from merge_block(pa.Table.from_batches(held).combine_chunks(), n).to_batches()


def stored_runs(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """(run, pos, g, s, i): the sorted runs of a table, written. They can be merged for any number of items up to n."""
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).cast("bigint").alias("g"), (value + F.lit(0.0)).alias("s"), F.col(item).cast("bigint").alias("i")).where("g is not null and i is not null and s is not null and not isnan(s) and abs(s) < double('infinity')")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, made, held, size = (context.partitionId() if context else 0) << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            g, s, i = (t.column(k).to_numpy() for k in range(3))
            keep = sorted_run(g, s, i, n)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), base + made)), pa.array(np.arange(len(keep))), pa.array(g[keep]), pa.array(s[keep]), pa.array(i[keep])], ["run", "pos", "g", "s", "i"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= RUN_ROWS:
                yield flush()
                made, held[:], size = made + 1, [], 0
        if held:
            yield flush()

    return write_table(rows.mapInArrow(runs, "run bigint, pos bigint, g bigint, s double, i bigint"), "runs")


def merge_stored(stored: DataFrame, n: int, buckets: int | None = None) -> DataFrame:
    """(g, i, s, rank): the n first rows of every group of stored runs."""
    if buckets is None:
        buckets = max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // BUCKET_ROWS))
    return stored.repartition(buckets, "g").sortWithinPartitions("g", "run", "pos").mapInArrow(lambda batches: merged(batches, n), "g bigint, i bigint, s double, rank int")


def top_per_group(df: DataFrame, group: str, score: str, item: str, n: int, buckets: int | None = None) -> DataFrame:
    """(group, item, score DOUBLE, rank): the n rows of highest score of every group, equal scores by smaller item; all rows of smaller groups.

    Rows with a null in one of the columns or a score that isn't finite are left out; -0.0 equals 0.0. Rows that agree in all three come out as often as they
    come in. Group and item are BIGINT; other columns are ignored. An empty table gives an empty one.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    best = merge_stored(stored_runs(df, group, score, item, n), n, buckets)
    return best.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")


def latest_of_pair(df: DataFrame, group: str, item: str, score: str, version: str) -> DataFrame:
    """(group, item, score): of each pair the score of its greatest version, of the rows that have all of them and a finite score. Copies of a row become one."""
    known = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    return known.groupBy(group, item).agg(F.max_by(score, version).alias(score))
