"""Mixing sources to target shares of the total size, with a cap on how often a record may occur.

Records of a source fall into blocks by a hash, as many as its size needs for blocks that are a small part of an output shard. A source gives whole copies
of itself, as many as fit, and of one further copy permuted blocks until its target is reached, the last block being cut between records. Numbers of blocks
are split among the output shards by a tree: at every node the left half gets its share of all blocks, and how many of each source is a draw from the
multivariate hypergeometric distribution, so shards are fair samples and the quotas of the sources exact. A shard's own range of the permuted blocks of each
source follows from the draws on its path, which any task can repeat; the driver holds a few numbers a source. Each shard is shuffled by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import write_table

#: Largest size of a shard in tokens, and blocks that make up a shard.
SHARD_TOKENS, SHARD_BLOCKS = 1 << 26, 64
#: Blocks of the mix up to which their table is sent to every executor (some 40 bytes each).
SMALL_UNITS = 1_000_000


@dataclass
class Share:
    source: str
    weight: float
    tokens: float  # that it should give
    copies: int  # whole ones
    rest: float  # tokens of the further copy


def _draw(have: np.ndarray, lo: int, hi: int, seed: int) -> tuple[int, np.ndarray]:
    """(middle, blocks of each source that the left half [lo, middle) of a node gets)."""
    mid = (lo + hi) // 2
    left = round(int(have.sum()) * (mid - lo) / (hi - lo))
    rng = np.random.default_rng([seed, lo, hi])
    return mid, rng.multivariate_hypergeometric(have, left, method="marginals") if have.sum() else have.copy()


def ranges(counts: np.ndarray, shards: int, seed: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, where its range of each source's permuted blocks begins, how many there are) of shards first to last - 1, by walking the tree only where they are."""
    stop = shards if last is None else last

    def node(lo: int, hi: int, at: np.ndarray, have: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= stop:
            return
        if hi - lo == 1:
            yield lo, at, have
            return
        mid, part = _draw(have, lo, hi, seed)
        yield from node(lo, mid, at, part)
        yield from node(mid, hi, at + part, have - part)

    counts = np.asarray(counts, np.int64)
    yield from node(0, shards, np.zeros_like(counts), counts)


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shards, sources] numbers of blocks: every column adds up to ``counts``, every shard gets an equal number of blocks to within rounding."""
    return np.stack([have for _, _, have in ranges(counts, shards, seed)])


def plan(whole: dict[str, int], targets: list[tuple[str, float, int]], total: float | None) -> list[Share]:
    """What each source gives. whole: tokens of each source. Weights of sources without records are spread over the others in proportion.

    Without ``total`` the mix is the largest in which every source reaches its share."""
    there = [(s, w, m) for s, w, m in targets if s is not None and (w or 0) > 0 and (m or 0) > 0 and whole.get(s, 0) > 0]
    if not there:
        return []
    weight = sum(w for _, w, _ in there)
    most = min(m * whole[s] * weight / w for s, w, m in there)
    size = most if total is None else min(total, most)
    shares = []
    for s, w, m in sorted(there):
        want = size * w / weight
        copies = min(m, int(want // whole[s] + 1e-9))
        shares.append(Share(s, w / weight, want, copies, want - copies * whole[s] if copies < m else 0.0))
    return shares


def shard_count(tokens: float, shard_tokens: int = SHARD_TOKENS) -> int:
    """Shards of a mix: their size grows with the root of the mix's, up to ``shard_tokens``."""
    return max(1, math.ceil(max(math.sqrt(tokens) / 64, tokens / shard_tokens)))


def units(blocks: DataFrame, shares: list[Share], shards: int, seed: int) -> DataFrame:
    """(source, block, copy, shard, most): the blocks of the mix with the shard of each; most is the number of tokens to take of a block that is cut.

    blocks: source, block, n (tokens)."""
    spark = blocks.sparkSession
    given = spark.createDataFrame([(k, s.source, s.copies, s.rest) for k, s in enumerate(shares)], "k int, source string, copies int, rest double")
    mine = blocks.join(F.broadcast(given), "source")
    drawn = W.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed)), "block").rowsBetween(W.unboundedPreceding, 0)
    further = mine.where("rest > 0").withColumn("cum", F.sum("n").over(drawn)).withColumn("before", F.col("cum") - F.col("n"))
    further = further.where((F.col("before") < F.col("rest") - 1e-6) & ((F.col("cum") <= F.col("rest") + 1e-6) | (F.col("rest") - F.col("before") >= 1)))
    further = further.select("k", "source", "block", F.col("copies").alias("copy"), F.when(F.col("cum") > F.col("rest") + 1e-6, F.col("rest") - F.col("before")).alias("most"))
    copied = mine.where("copies > 0").select("k", "source", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("double").alias("most"))
    every = copied.unionByName(further)
    permuted = W.partitionBy("source").orderBy(F.xxhash64("source", "block", "copy", F.lit(seed + 1000)), "block", "copy")
    every = write_table(every.withColumn("place", F.row_number().over(permuted) - 1), "units")
    counts = np.zeros(len(shares), np.int64)
    for r in every.groupBy("k").agg(F.count("*").alias("n")).collect():  # one number a source
        counts[r.k] = r.n

    def quotas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mine = b.column(0).to_numpy()
                for shard, at, have in ranges(counts, shards, seed, int(mine.min()), int(mine.max()) + 1):
                    k = np.flatnonzero(have)
                    size = have[k]
                    place = np.repeat(at[k] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, size).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(np.full(size.sum(), shard, np.int32))], ["k", "place", "shard"])

    of_shard = spark.range(shards).mapInArrow(quotas, "k int, place int, shard int")
    return every.join(of_shard, ["k", "place"]).select("source", "block", "copy", "shard", "most")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, shard_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """((shard, place, doc_id, source, copy, n_tokens) of the mix, (source, target_weight, target_share, reached_share, n_tokens, n_docs, most_copies) of each source).

    docs: doc_id (unique), source, n_tokens; targets: source, target_weight, max_repeats (few rows). Records without a source, of sources that aren't
    listed or without tokens take no part. A listed source without records reaches 0, its weight goes to the others in proportion (target_share).
    copy counts from 0; place orders a shard at random. Shares differ from their targets by less than one record. Shards have about ``shard_tokens``
    tokens, by default as many as ``shard_count`` says.
    """
    spark = docs.sparkSession
    wanted = [(r.source, r.target_weight, r.max_repeats) for r in targets.select("source", "target_weight", "max_repeats").dropDuplicates(["source"]).collect()]
    listed = F.broadcast(targets.select("source").where("source is not null").distinct())
    rows = docs.where("source is not null and n_tokens > 0").join(listed, "source", "left_semi").select("doc_id", "source", "n_tokens")
    whole = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # the listed sources
    shares = plan(whole, wanted, total)
    planned_tokens = sum(s.tokens for s in shares)
    shards = shard_count(planned_tokens) if shard_tokens is None else max(1, round(planned_tokens / shard_tokens))
    block_tokens = max(1.0, planned_tokens / shards / SHARD_BLOCKS)
    many = spark.createDataFrame([(s.source, max(1, math.ceil(whole[s.source] / block_tokens))) for s in shares], "source string, blocks bigint")
    rows = rows.join(F.broadcast(many), "source").select("doc_id", "source", "n_tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))
    unit = units(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")), shares, shards, seed)
    small = sum((s.copies + 1) * max(1, math.ceil(whole[s.source] / block_tokens)) for s in shares) <= SMALL_UNITS
    taken = rows.join(F.broadcast(unit) if small else unit, ["source", "block"])
    order = F.xxhash64("doc_id", "copy", F.lit(seed + 1))
    run = W.partitionBy("source").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, 0)  # of the one block a source that is cut
    part = taken.where("most is not null").withColumn("cum", F.sum("n_tokens").over(run)).where("cum <= most").drop("cum")
    out = taken.where("most is null").unionByName(part).withColumn("place", order).select("shard", "place", "doc_id", "source", "copy", "n_tokens")
    out = write_table(out.repartition("shard").sortWithinPartitions("shard", "place"), "mix")
    got = out.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), (F.max("copy") + 1).alias("most_copies"))
    all_tokens = float(out.agg(F.sum("n_tokens").alias("n")).first().n or 0)
    planned = spark.createDataFrame([(s, float(w or 0), next((x.weight for x in shares if x.source == s), 0.0)) for s, w, _ in wanted], "source string, target_weight double, target_share double")
    report = planned.join(got, "source", "left").select("source", "target_weight", "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.lit(all_tokens or 1.0)).alias("reached_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    return out, report
