"""SQL that gives the results of the registered queries of the core, for any engine with lists and lambdas."""

SPLIT = "TIMESTAMP '1998-05-24'"
DELTAS = "d AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity::DOUBLE AS v, l_returnflag = 'R' AS del, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
PREFS = f"{DELTAS}, p AS (SELECT user_id, item_id, sum(v) AS value FROM d GROUP BY ALL)"
TAG = "CAST(CASE WHEN {h} >= 9223372036854775808::UHUGEINT THEN {h}::HUGEINT - 18446744073709551616::HUGEINT ELSE {h}::HUGEINT END AS BIGINT)"


def tag(s: str) -> str:
    return TAG.format(h=f"(('0x' || substr(md5({s}), 1, 16))::UBIGINT)")


ID, NUM = r"[+-]?[0-9]+", r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
TRIMMED = r"list_transform(string_split(raw_line, ','), lambda x: trim(x, chr(32) || chr(9) || chr(13)))"
PARSED = f"""f AS (SELECT line_id, {TRIMMED} AS f FROM inbound_lines WHERE raw_line IS NOT NULL AND raw_line <> '' AND raw_line NOT LIKE '#%'),
g AS (SELECT line_id, len(f) AS n, f[1] AS u, f[2] AS i, f[3] AS v, starts_with(f[1], '"') AS ut, coalesce(starts_with(f[2], '"'), false) AS it FROM f),
h AS (SELECT *, CASE WHEN ut AND length(u) > 1 THEN {tag("substr(u, 2, length(u) - 2)")} WHEN NOT ut AND regexp_full_match(u, '{ID}') THEN try_cast(u AS BIGINT) END AS uid,
 CASE WHEN it AND length(i) > 1 THEN {tag("substr(i, 2, length(i) - 2)")} WHEN NOT it AND regexp_full_match(i, '{ID}') THEN try_cast(i AS BIGINT) END AS iid,
 n >= 3 AND v = '' AS del,
 CASE WHEN n < 3 THEN 1.0 WHEN regexp_full_match(v, '{NUM}') AND abs(try_cast(v AS DOUBLE)) < 3.4028235677973366e38 THEN v::DOUBLE::FLOAT END AS val FROM g),
parsed AS (SELECT *, uid IS NULL OR iid IS NULL OR (ut AND it) OR (val IS NULL AND NOT del) AS bad FROM h)"""


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def cells(source: str, keys: str, vector: str, k: int) -> str:
    return f"SELECT {keys}, pos::INT AS pos, {r6(f'{vector}[pos + 1]::DOUBLE')} AS v FROM {source}, range({k}) t(pos)"


EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings)"
NORM = "sqrt(list_inner_product({0}, {0}))"
CENTROIDS = f"{EMB}, c AS (SELECT label AS cluster, arg_min(f, id) AS c FROM e GROUP BY label)"
ASSIGN = f"""{CENTROIDS}, s AS (SELECT id, cluster, f, round(list_inner_product(f, c) / ({NORM.format('f')} * {NORM.format('c')}), 9) AS cos FROM e, c),
a AS (SELECT id, f, cluster FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, cluster) = 1)"""
K2 = f"""{PREFS}, r AS (SELECT user_id, item_id, (CASE WHEN (user_id + item_id) % 5 = 0 THEN -value ELSE value END) / 10.0::DOUBLE AS r FROM p),
y AS (SELECT DISTINCT item_id, (item_id * 7 % 101)::DOUBLE / 101.0::DOUBLE + 0.1::DOUBLE AS a, (item_id * 13 % 97)::DOUBLE / 97.0::DOUBLE - 0.3::DOUBLE AS b FROM r),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM y)"""


def solve(weight: str, target: str, gram: int, lam: float = 0.1) -> str:
    return f"""WITH {K2}, w AS (SELECT user_id, {gram} * any_value(g.aa) + sum({weight} * a * a) + {lam}::DOUBLE * count(*) AS aa, {gram} * any_value(g.ab) + sum({weight} * a * b) AS ab,
 {gram} * any_value(g.bb) + sum({weight} * b * b) + {lam}::DOUBLE * count(*) AS bb, sum({target} * a) AS ta, sum({target} * b) AS tb FROM r JOIN y USING (item_id), g GROUP BY user_id),
x AS (SELECT user_id AS id, [(bb * ta - ab * tb) / (aa * bb - ab * ab), (aa * tb - ab * ta) / (aa * bb - ab * ab)] AS f FROM w) {cells('x', 'id', 'f', 2)}"""


CONF, TARGET = "abs(r)", "(CASE WHEN r > 0 THEN 1.0 + abs(r) ELSE 0.0 END)"
WORK = f"""{PREFS}, {EMB}, k AS (SELECT user_id % 250 * 2 AS id, list_sort(list(DISTINCT item_id % 250 * 2 + 1)) AS known FROM p GROUP BY 1),
x AS (SELECT e.id, f, known FROM e JOIN k ON e.id = k.id WHERE e.id % 2 = 0)"""
RECS = f"""{WORK}, s AS (SELECT x.id, y.id AS other_id, round(list_inner_product(x.f, y.f), 6) + 0.0 AS score FROM x, e y WHERE y.id % 2 = 1 AND NOT list_contains(known, y.id)),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id)::INT AS rank FROM s QUALIFY rank <= 10)"""
SIMILAR = f"""{EMB}, u AS (SELECT id, f, {NORM.format('f')} AS n FROM e), s AS (SELECT a.id, b.id AS other_id, round(list_inner_product(a.f, b.f) / (a.n * b.n), 6) + 0.0 AS score FROM u a, u b WHERE a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id)::INT AS rank FROM s QUALIFY rank <= 10)"""
CHAIN = f"{EMB}, j AS (SELECT a.f[1:8] AS y, b.f[9:14] AS x FROM e a JOIN e b USING (id) WHERE id % 3 = 0), z AS (SELECT r, c, y[r + 1] * x[c + 1] AS v FROM j, range(8) t(r), range(6) s(c))"
OLD = f"o AS (SELECT user_id, item_id, sum(v) AS ov FROM d WHERE l_shipdate < {SPLIT} GROUP BY ALL)"


def merged(decay: float, threshold: float, deletes: bool) -> str:
    live = "NOT del" if deletes else "true"
    return f"""WITH {DELTAS}, {OLD}, n AS (SELECT user_id, item_id, sum(v) FILTER ({live}) AS nv, {'bool_or(del)' if deletes else 'false'} AS gone FROM d WHERE l_shipdate >= {SPLIT} GROUP BY ALL),
m AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN ov IS NOT NULL THEN ov * {decay} + coalesce(nv, 0) ELSE nv END AS value, ov IS NOT NULL AND coalesce(gone, false) AS dropped
 FROM o FULL JOIN n ON o.user_id = n.user_id AND o.item_id = n.item_id) SELECT user_id, item_id, {r6('value')} AS value FROM m WHERE NOT dropped AND abs(value) > {threshold}"""


def decimal_list(f: str) -> str:
    return f"list_aggregate(list_transform({f}, lambda x: round(x, 6)::DECIMAL(18,6)::VARCHAR), 'string_agg', ',')"


SEEN = """runs AS (SELECT DISTINCT instance_id, coalesce(last_generation_id, -1) AS lo, generation_id AS hi, started_at FROM generation_runs WHERE done_marker),
d AS (SELECT r.rec_id, r.instance_id, r.write_id, r.revision, r.generation_id, EXISTS (SELECT 1 FROM runs u WHERE u.instance_id = r.instance_id AND u.lo < r.generation_id AND r.generation_id <= u.hi AND r.landed_at <= u.started_at) AS done FROM pref_deltas r)"""
LINES = f"""f AS (SELECT line_id, {TRIMMED} AS f FROM inbound_lines WHERE raw_line IS NOT NULL AND raw_line <> '' AND raw_line NOT LIKE '#%'),
g AS (SELECT line_id, len(f) AS n, f[1] AS u, f[2] AS i, f[3] AS v, contains(f[1], '"') AS ut, contains(f[2], '"') AS it FROM f),
reasons AS (SELECT *, CASE WHEN n < 2 OR n > 4 THEN 'column_count' WHEN (ut AND NOT regexp_full_match(u, '"[^"]+"', 's')) OR (it AND NOT regexp_full_match(i, '"[^"]+"', 's')) THEN 'quoting'
 WHEN ut AND it THEN 'both_tags' WHEN NOT ut AND (NOT regexp_full_match(u, '{ID}') OR try_cast(u AS BIGINT) IS NULL) THEN 'user_id' WHEN NOT it AND (NOT regexp_full_match(i, '{ID}') OR try_cast(i AS BIGINT) IS NULL) THEN 'item_id'
 WHEN n > 2 AND v <> '' AND NOT (regexp_full_match(v, '{NUM}') AND coalesce(abs(try_cast(v AS DOUBLE)) < 3.4028235677973366e38, false)) THEN 'value' END AS reason FROM g)"""

# Every user gets ten items, or all that it doesn't know, none that it knows, best first.
RECOMMENDED = f"""WITH {PREFS}, k AS (SELECT user_id AS id, count(DISTINCT item_id) AS known FROM p GROUP BY user_id)
SELECT id, least(10, (SELECT count(DISTINCT item_id) FROM p) - known)::BIGINT AS n_recs, 0::BIGINT AS n_known, true AS in_order FROM k WHERE known < (SELECT count(DISTINCT item_id) FROM p)"""

ORACLES = {
    "parse_events": f"WITH {PARSED} SELECT line_id, uid AS user_id, iid AS item_id, CASE WHEN NOT del THEN round(val::DOUBLE, 4) + 0.0 END AS pref_value, del AS is_delete, ut AS user_is_tag, it AS item_is_tag FROM parsed WHERE NOT bad",
    "bad_lines": f"WITH {PARSED} SELECT count(*) AS n_lines, count(*) FILTER (bad) AS n_bad FROM parsed",
    "tags_extracted": f"WITH {PARSED} SELECT DISTINCT 'item' AS kind, uid AS id FROM parsed WHERE NOT bad AND ut UNION SELECT DISTINCT 'user', iid FROM parsed WHERE NOT bad AND it",
    "tags_merged": f"WITH {PARSED} SELECT DISTINCT uid AS id FROM parsed WHERE NOT bad AND ut AND abs(line_id % 2) <= 1",
    "append_lines_roundtrip": f"""SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN {tag('event_type')} ELSE json_extract_string(props, '$.k')::BIGINT END AS item_id,
 CASE WHEN event_id % 7 <> 0 THEN round(value, 4) END AS pref_value, event_id % 7 = 0 AS is_delete, event_id % 5 = 0 AS item_is_tag FROM events""",
    "factors_text_roundtrip": f"WITH {EMB} {cells('e', 'id', 'f', 64)}",
    "known_text_roundtrip": f"WITH {PREFS} SELECT user_id, item_id FROM p",
    "merge_new_only": f"WITH {DELTAS} SELECT user_id, item_id, {r6('sum(v)')} AS value FROM d WHERE l_shipdate >= {SPLIT} AND NOT del GROUP BY ALL HAVING abs(sum(v)) > 0",
    "merge_old_new": merged(1.0, 0.0, False),
    "merge_decay": merged(0.5, 0.0, False),
    "merge_tombstones": merged(1.0, 0.0, True),
    "merge_threshold": merged(0.5, 12.0, True),
    "user_vectors": f"WITH {PREFS} SELECT user_id, string_agg(item_id || ':' || round(value, 2)::DECIMAL(18,2), ',' ORDER BY item_id) AS entries FROM p GROUP BY user_id",
    "item_vectors": f"WITH {PREFS} SELECT item_id, string_agg(user_id || ':' || round(value, 2)::DECIMAL(18,2), ',' ORDER BY user_id) AS entries FROM p GROUP BY item_id",
    "known_items": f"WITH {PREFS} SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM p GROUP BY user_id",
    "popular_items": f"WITH {PREFS} SELECT DISTINCT ((user_id % 4 + 4) % 4)::INT AS part, item_id FROM p",
    "popular_users": f"WITH {PREFS} SELECT DISTINCT ((item_id % 4 + 4) % 4)::INT AS part, user_id FROM p",
    "initial_y_ids": f"WITH {PREFS}, {EMB}, i AS (SELECT DISTINCT item_id AS id FROM p), y AS (SELECT id, len(f) AS n FROM e WHERE id % 3 = 0) SELECT coalesce(i.id, y.id) AS id, coalesce(n, 0)::INT AS length FROM i FULL JOIN y ON i.id = y.id",
    "initial_y_truncate": f"WITH {EMB}, t AS (SELECT id, list_transform(f[1:20], lambda x: x / sqrt(list_inner_product(f[1:20], f[1:20]))) AS g FROM e) {cells('t', 'id', 'g', 20)}",
    "gramian": f"WITH {EMB} SELECT r::INT AS r, c::INT AS c, {r6('sum(f[r + 1] * f[c + 1])')} AS v FROM e, range(64) t(r), range(64) s(c) GROUP BY ALL",
    "als_normal_k2": f"""WITH {K2}, w AS (SELECT user_id AS id, any_value(g.aa) + sum({CONF} * a * a) + 0.1::DOUBLE * count(*) AS aa, any_value(g.ab) + sum({CONF} * a * b) AS ab, any_value(g.bb) + sum({CONF} * b * b) + 0.1::DOUBLE * count(*) AS bb,
 sum({TARGET} * a) AS ta, sum({TARGET} * b) AS tb FROM r JOIN y USING (item_id), g GROUP BY user_id), m AS (SELECT id, [[aa, ab, ta], [ab, bb, tb]] AS m FROM w)
 SELECT id, r::INT AS r, c::INT AS c, {r6('m[r + 1][c + 1]')} AS v FROM m, range(2) t(r), range(3) s(c)""",
    "als_row_solve_k2": solve(CONF, TARGET, 1),
    "als_reconstruct_k2": solve("0.0::DOUBLE", "r", 1),
    "als_observed_only_k2": solve(f"(1.0 + {CONF})", TARGET, 0),
    "als_row_solve_alpha2": solve("2.0::DOUBLE * abs(r)", "(CASE WHEN r > 0 THEN 1.0::DOUBLE + 2.0::DOUBLE * abs(r) ELSE 0.0 END)", 1, 0.2),
    "als_flagship_checked": RECOMMENDED,
    "als_default": RECOMMENDED,
    "initial_y_random": f"WITH {PREFS}, i AS (SELECT DISTINCT item_id AS id FROM p UNION SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) SELECT id, 20 AS k, 1.0::DOUBLE AS norm FROM i",
    "rank_gate": "SELECT * FROM (VALUES ('x', true), ('y', true), ('singular', false)) t(matrix, full_rank)",
    "kmeans_seed_rows": "SELECT i::INT AS cluster, true AS is_row FROM range(10) t(i)",
    "convergence_sample": f"WITH {EMB} SELECT y.id AS row_id, x.id AS col_id, {r6('list_inner_product(x.f, y.f)')} AS estimate FROM e x, e y WHERE x.id % 10 = 0 AND y.id % 2 = 1 AND y.id % 5 = 0",
    "convergence_value": f"""WITH c AS (SELECT item_id, user_id, iteration, max(estimate::DOUBLE) AS e FROM convergence WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND isfinite(estimate) GROUP BY ALL)
 SELECT {r6('sum(greatest(a.e, 0) * abs(a.e - b.e)) / sum(greatest(a.e, 0))')} AS value FROM c a JOIN c b ON a.item_id = b.item_id AND a.user_id = b.user_id AND a.iteration = 3 AND b.iteration = 2""",
    "cluster_assign": f"WITH {ASSIGN} SELECT id, cluster FROM a",
    "cluster_adjust": f"WITH {ASSIGN} SELECT cluster, count(*) AS weight, pos::INT AS pos, {r6('sum(f[pos + 1])')} AS v FROM a, range(64) t(pos) GROUP BY cluster, pos",
    "publish_clusters": f"WITH {ASSIGN} SELECT id || chr(9) || cluster AS line FROM a WHERE id % 10 <> 3",
    "publish_centroids": f"WITH {CENTROIDS} SELECT cluster || chr(9) || {decimal_list('c')} AS line FROM c",
    "publish_factors": f"WITH {EMB} SELECT id || chr(9) || {decimal_list('f')} AS line FROM e",
    "recommend_work": f"WITH {WORK} SELECT id, round({NORM.format('f')}, 4) AS norm, list_aggregate(list_transform(known, lambda i: i::VARCHAR), 'string_agg', ',') AS known FROM x",
    "recommend_topn": f"WITH {RECS} SELECT id, rank, other_id, score FROM t",
    "recommend_formatted": f"WITH {RECS} SELECT id, '[' || string_agg('[' || other_id || ',' || score::DECIMAL(18,6) || ']', ',' ORDER BY rank) || ']' AS line FROM t GROUP BY id",
    "similar_topn": f"WITH {SIMILAR} SELECT id, rank, other_id, score FROM t",
    "recommend_topn_blocks": f"WITH {RECS} SELECT id, rank, other_id, score FROM t",
    "similar_topn_blocks": f"WITH {SIMILAR} SELECT id, rank, other_id, score FROM t",
    "similar_formatted": f"WITH {SIMILAR} SELECT id, '[' || string_agg(other_id || ':' || score::DECIMAL(18,6), ',' ORDER BY rank) || ']' AS line FROM t GROUP BY id",
    "ytx_partial": f"WITH {CHAIN} SELECT r::INT AS r, c::INT AS c, count(*) AS n, {r6('max(v)')} AS most FROM z GROUP BY ALL",
    "ytx_matrix": f"WITH {CHAIN} SELECT r::INT AS r, c::INT AS c, {r6('sum(v)')} AS v FROM z GROUP BY ALL",
    "merged_y": f"WITH {CHAIN}, m AS (SELECT r, c, sum(v) AS v FROM z GROUP BY ALL) SELECT id, r::INT AS pos, {r6('sum(v * f[9 + c])')} AS v FROM m, e WHERE id % 2 = 1 GROUP BY id, r",
    "model_load_partition": f"WITH {EMB} SELECT id, round({NORM.format('f')}, 4) AS norm FROM e WHERE (id % 3 + 3) % 3 = 2",
    "clusters_loaded": f"WITH {CENTROIDS} SELECT cluster, string_agg(id::VARCHAR, ',' ORDER BY id) AS members, round(any_value({NORM.format('c')}), 4) AS norm FROM e JOIN c ON label = cluster GROUP BY cluster",
    "prune_not_updated": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 4 = 0 OR vec_id IN (SELECT user_id FROM events)",
    "p2_found": f"""WITH {SEEN}, w AS (SELECT instance_id, write_id, max(revision) FILTER (done) AS seen, max(revision) FILTER (NOT done) AS due FROM d GROUP BY ALL)
 SELECT min(rec_id) AS rec_id FROM d JOIN w USING (instance_id, write_id) WHERE NOT done AND revision = due AND (seen IS NULL OR due > seen) GROUP BY instance_id, write_id""",
    "p2_partitions": f"WITH {SEEN} SELECT instance_id, generation_id, count(*) AS n_rows, count(*) FILTER (done) AS n_seen, count(*) <> count(*) FILTER (done) AS changed FROM d GROUP BY ALL",
    "p3_found": f"WITH {LINES} SELECT line_id, reason FROM reasons WHERE reason IS NOT NULL",
    "p3_loaded": f"""WITH {LINES} SELECT line_id, CASE WHEN NOT ut THEN u::BIGINT END AS user_id, CASE WHEN ut THEN u[2:-2] END AS user_tag, CASE WHEN NOT it THEN i::BIGINT END AS item_id, CASE WHEN it THEN i[2:-2] END AS item_tag,
 round(CASE WHEN n = 2 THEN 1.0::DOUBLE WHEN v <> '' THEN v::DOUBLE END, 4) + 0.0 AS value, n > 2 AND v = '' AS is_delete FROM reasons WHERE reason IS NULL""",
    "p3_records": """WITH q AS (SELECT file_name, line_id, coalesce(raw_line, '') AS t, coalesce(sum(length(raw_line) - length(replace(raw_line, '"', ''))) OVER (PARTITION BY file_name ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS open FROM inbound_lines),
s AS (SELECT file_name, line_id, t, max(CASE WHEN NOT open THEN line_id END) OVER (PARTITION BY file_name ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM q),
r AS (SELECT file_name, head AS line_id, count(*) AS n_lines, string_agg(t, chr(10) ORDER BY line_id) AS record FROM s GROUP BY file_name, head)
SELECT file_name, line_id, n_lines, CASE WHEN n_lines <= 10000 THEN md5(record) END AS record FROM r""",
    "p7_found": "SELECT user_id FROM pref_deltas WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) * 100 >= (SELECT count(user_id) FROM pref_deltas)",
    "p7_joined": """SELECT d.user_id, x.generation_id, count(*) AS n_rows, min(rec_id) AS first_rec, max(rec_id) AS last_rec FROM pref_deltas d
 JOIN (SELECT user_id, max(generation_id) AS generation_id FROM factors_x GROUP BY user_id) x ON d.user_id = x.user_id GROUP BY ALL""",
    "p7_user_loads": "SELECT user_id, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, round(sum(pref_value::DOUBLE), 3) AS sum_value FROM pref_deltas WHERE user_id IS NOT NULL GROUP BY user_id",
}
ORACLES["p3_records_whole"] = ORACLES["p3_records"].replace("CASE WHEN n_lines <= 10000 THEN md5(record) END", "md5(record)")
