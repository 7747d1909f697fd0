import numpy as np
import pytest

from factorloom.llm import mixing


def docs(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for source, many in (("big", 3000), ("mid", 400), ("small", 60), (None, 50), ("unlisted", 50)):
        for _ in range(many):
            rows.append((n, source, int(rng.integers(0, 90)), "x"))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, shard string"), rows


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 5), ("gone", 0.1, 3)]


def targets(spark, t=TARGETS):
    return spark.createDataFrame(t, "source string, target_weight double, max_repeats int")


def test_shares_and_caps(spark):
    d, rows = docs(spark)
    out, report = mixing.mix(d, targets(spark), shard_tokens=5000)
    got = out.collect()
    r = {x.source: x for x in report.collect()}
    assert r["gone"].reached_share == 0 and r["gone"].target_share == 0
    total = sum(x.n_tokens for x in got)
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert r[s].target_share == pytest.approx(share) and abs(r[s].reached_share - share) * total <= 3 * 90
    size = {n: (s, t) for n, s, t, _ in rows}
    uses = {}
    for x in got:
        assert size[x.doc_id] == (x.source, x.n_tokens) and x.n_tokens > 0
        uses.setdefault((x.doc_id, x.source), []).append(x.copy)
    most = {s: m for s, _, m in TARGETS}
    assert all(len(set(c)) == len(c) <= most[s] for (_, s), c in uses.items())
    assert max(len(c) for (_, s), c in uses.items() if s == "small") == 5  # the source that sets the size of the mix
    per = {}
    for x in got:
        per.setdefault(x.shard, []).append(x)
    assert len(per) == round(total / 5000) and all(abs(sum(x.n_tokens for x in v) - total / len(per)) < 0.25 * total / len(per) for v in per.values())
    again = sorted(map(repr, mixing.mix(d.repartition(7), targets(spark), shard_tokens=5000)[0].collect()))
    assert again == sorted(map(repr, got))


def test_smaller_total_and_nothing(spark):
    d, _ = docs(spark)
    out, _ = mixing.mix(d, targets(spark), total=9000)
    assert abs(sum(x.n_tokens for x in out.collect()) - 9000) < 300
    for few in (d.limit(0), d.where("source is null")):
        out, report = mixing.mix(few, targets(spark))
        assert out.count() == 0 and {x.reached_share for x in report.collect()} == {0.0}


def test_splitting_tree():
    counts = np.array([1000, 0, 37, 5])
    for shards in (1, 2, 7, 16):
        q = mixing.split(counts, shards, 3)
        assert (q.sum(axis=0) == counts).all() and (q >= 0).all() and np.ptp(q.sum(axis=1)) <= shards
    assert (mixing.split(counts, 7, 3) == mixing.split(counts, 7, 3)).all()


@pytest.mark.parametrize("shards", [1, 5, 64])
def test_a_task_finds_its_own_shards(shards):
    counts = np.array([900, 0, 41])
    every = list(mixing.ranges(counts, shards, 9))
    assert [s for s, _, _ in every] == list(range(shards))
    ends = np.zeros(3, int)
    for shard, at, have in every:
        assert (at == ends).all()
        ends = ends + have
        ((one, a, h),) = mixing.ranges(counts, shards, 9, shard, shard + 1)
        assert one == shard and (a == at).all() and (h == have).all()
    assert (ends == counts).all()


def test_the_tree_decides_where_blocks_go(spark, monkeypatch):
    d, _ = docs(spark)
    one = {(r.doc_id, r.copy): r.shard for r in mixing.mix(d, targets(spark))[0].collect()}
    assert len(set(one.values())) == mixing.shard_count(sum(r.n_tokens for r in mixing.mix(d, targets(spark))[0].collect())) > 1
    big = mixing.shard_count(2.5e13)
    assert 2.5e13 / big <= mixing.SHARD_TOKENS


def test_a_cut_that_leaves_nothing(spark):
    d = spark.createDataFrame([(i, s, 10) for i, s in enumerate("aaaaabbbbb")], "doc_id bigint, source string, n_tokens bigint")
    t = targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert sorted(r.doc_id for r in mixing.mix(d, t)[0].collect()) == list(range(10))
    assert mixing.mix(d, t, total=50)[0].count() in (4, 5)
