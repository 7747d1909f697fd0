"""Registered queries of this package and the SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import write_table
from . import frequent, grid, hnsw, mixing, residue, runs, tokens, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _clusters(spark, sf):
    tables = [(side, table(spark, sf, f"factors_{side}"), key) for side, key in (("x", "user_id"), ("y", "item_id"))]
    now = [vectors.current(t, key).select(F.lit(side).alias("side"), "id", "features") for side, t, key in tables]
    fit = [vectors.usable_rows(t, key) for _, t, key in tables]
    return grid.cluster(now[0].unionByName(now[1]), fit=fit[0].unionByName(fit[1]))


@query
def p1_found(spark, sf):
    return _clusters(spark, sf)[0]


@query
def p1_clusters(spark, sf):
    out = grid.describe(_clusters(spark, sf)[1])
    return out.withColumn("typical", F.array_join(F.transform("typical", lambda i: i.cast("string")), ","))


def _top(spark, sf):
    pairs = runs.latest_of_pair(table(spark, sf, "convergence"), "user_id", "item_id", "estimate", "iteration")
    return runs.top_per_group(pairs, "user_id", "estimate", "item_id", 10)


@query
def p1_sizes(spark, sf):
    return grid.describe(_clusters(spark, sf)[1]).select("side", "root_id", "size")


@query
def p4_found(spark, sf):
    return _top(spark, sf).select("user_id", "item_id")


@query
def p4_ranked(spark, sf):
    return _top(spark, sf).select("user_id", "item_id", "rank", F.round("estimate", 4).alias("estimate"))


@query
def p5_found(spark, sf):
    return frequent.frequent(table(spark, sf, "pref_deltas"), "item_id", 0.005).select("item_id")


@query
def p5_counts(spark, sf):
    return frequent.frequent(table(spark, sf, "pref_deltas"), "item_id", 0.005).select("item_id", "n_rows")


def _near(spark, sf, reach=hnsw.REACH):
    return hnsw.neighbours(vectors.current(table(spark, sf, "factors_y"), "item_id"), 5, reach=reach)


@query
def p6_found(spark, sf):
    return hnsw.mutual(_near(spark, sf), 0.992).select("id_a", "id_b")


@query
def p6_neighbours(spark, sf):
    near = _near(spark, sf, float("inf"))  # a neighbour may be behind any border
    return near.select("id", F.posexplode("near").alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("other_id"), F.round("x.cosine", 6).alias("cosine"))


@query
def p8_ids(spark, sf):
    return tokens.token_ids(table(spark, sf, "documents"), "doc_id", "text")


def _mix(spark, sf):
    docs = write_table(tokens.token_counts(table(spark, sf, "documents"), ["doc_id", "source"], "text"), "sizes")
    return mixing.mix(docs, table(spark, sf, "mix_targets"))


@query
def p9_mix(spark, sf):
    return _mix(spark, sf)[0]


@query
def p9_shares(spark, sf):
    return _mix(spark, sf)[1]


@query
def p9_reached(spark, sf):
    """Target shares, and whether each source is within one document of its own."""
    docs = write_table(tokens.token_counts(table(spark, sf, "documents"), ["doc_id", "source"], "text"), "sizes")
    _, shares = mixing.mix(docs, table(spark, sf, "mix_targets"))
    largest = docs.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
    within = F.abs(F.col("n_tokens") - F.col("target_share") * total) <= 2 * F.coalesce("largest", F.lit(0)) + 1
    return shares.join(largest, "source", "left").select("source", F.round("target_share", 6).alias("target_share"), within.alias("within"))


@query
def p10_parts(spark, sf):
    """Documents of each source, found or kept: the two must make up all."""
    docs = table(spark, sf, "documents")
    found = write_table(residue.residue(docs), "found")
    part = docs.select("doc_id", "source").join(found.withColumn("_found", F.lit(1)), "doc_id", "left")
    return part.groupBy("source").agg((F.count("_found") + F.count_if(F.col("_found").isNull())).alias("n_docs"), F.count_distinct("doc_id").alias("n_ids"))


@query
def p10_found(spark, sf):
    return residue.residue(table(spark, sf, "documents"))


@query
def p10_evidence(spark, sf):
    """What speaks for each suspect record, found or not."""
    return residue.evidence(table(spark, sf, "documents"))


@query
def p10_kept(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.join(residue.residue(docs), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


TOP = """b AS (SELECT user_id, item_id, arg_max(estimate, iteration) + 0.0 AS estimate FROM convergence WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND isfinite(estimate) GROUP BY ALL),
t AS (SELECT user_id, item_id, estimate, row_number() OVER (PARTITION BY user_id ORDER BY estimate DESC, item_id)::INT AS rank FROM b QUALIFY rank <= 10)"""
CURRENT = """(SELECT side, id, f, sqrt(list_sum(list_transform(f, lambda v: v * v))) AS n FROM (SELECT side, id, features::DOUBLE[] AS f FROM ({0})
 QUALIFY row_number() OVER (PARTITION BY side, id ORDER BY generation_id DESC) = 1)
 WHERE len(f) = 50 AND len(list_filter(f, lambda v: v IS NOT NULL AND isfinite(v))) = 50 AND len(list_filter(f, lambda v: v <> 0)) > 0)"""
X = "SELECT 'x' AS side, user_id AS id, features, generation_id FROM factors_x"
Y = "SELECT 'y' AS side, item_id AS id, features, generation_id FROM factors_y"
COSINE = "list_inner_product(a.f, b.f) / (a.n * b.n)"
# Components by reaching out from the ids that are the smallest among their own partners; the smallest of a component is one of them.
LINKED = f"""v AS MATERIALIZED {CURRENT.format(X + " UNION ALL " + Y)}, e AS MATERIALIZED (SELECT a.side, a.id AS a, b.id AS b FROM v a JOIN v b ON a.side = b.side WHERE {COSINE} >= 0.8),
r AS (SELECT side, a AS root, a AS id FROM e GROUP BY side, a HAVING min(b) = a UNION SELECT r.side, r.root, e.b FROM r JOIN e ON e.side = r.side AND e.a = r.id),
c AS (SELECT side, id, min(root) AS root_id FROM r GROUP BY side, id)"""
CLOSE = f"""v AS MATERIALIZED {CURRENT.format(Y)}, s AS (SELECT a.id AS a, b.id AS b, {COSINE} AS cos FROM v a, v b WHERE a.id <> b.id),
t AS (SELECT a, b, cos FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(cos, 12) DESC, b) <= 5)"""
FREQUENT = "SELECT item_id, count(*) AS n_rows FROM pref_deltas WHERE item_id IS NOT NULL GROUP BY item_id HAVING count(*) * 200 >= (SELECT count(item_id) FROM pref_deltas)"
ORACLES: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {LINKED} SELECT side, root_id, id FROM c QUALIFY count(*) OVER (PARTITION BY side, root_id) >= 5",
    "p1_sizes": f"WITH RECURSIVE {LINKED} SELECT side, root_id, count(*) AS size FROM c GROUP BY side, root_id HAVING count(*) >= 5",
    "p9_reached": """WITH t AS (SELECT source, target_weight, max_repeats FROM mix_targets), h AS (SELECT DISTINCT source FROM documents WHERE text IS NOT NULL AND text <> '' AND source IS NOT NULL),
w AS (SELECT source, CASE WHEN source IN (SELECT source FROM h) AND target_weight > 0 AND max_repeats > 0 THEN target_weight ELSE 0 END AS w FROM t) SELECT source, round(w / (SELECT sum(w) FROM w), 6) AS target_share, true AS within FROM w""",
    "p10_parts": "SELECT source, count(*) AS n_docs, count(DISTINCT doc_id) AS n_ids FROM documents GROUP BY source",
    "p6_found": f"WITH {CLOSE} SELECT t.a AS id_a, t.b AS id_b FROM t JOIN t u ON t.a = u.b AND t.b = u.a WHERE t.a < t.b AND t.cos >= 0.992",
    "p4_found": f"WITH {TOP} SELECT user_id, item_id FROM t",
    "p4_ranked": f"WITH {TOP} SELECT user_id, item_id, rank, round(estimate::DOUBLE, 4) AS estimate FROM t",
    "p5_found": f"SELECT item_id FROM ({FREQUENT})",
    "p5_counts": FREQUENT,
}
