"""The same relations and queries in DuckDB's SQL, written on their own."""

from __future__ import annotations

from simgate.plans.inputs import CALIBRATION, HARD, REFERENCE, SEED, STEP, TEST, TEST_FRACTION, THRESHOLD

_HARD = ", ".join(f"'{h}'" for h in HARD)

BASE = f"""
WITH unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12)) AS u
  FROM embeddings),
pos AS (SELECT vec_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM embeddings WHERE label = 0),
neg AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || CAST(label AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR)), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n
  FROM embeddings WHERE label <> 0),
roles AS (
  SELECT 'positive' AS dataset, CASE WHEN rn <= {TEST} THEN 'test' WHEN rn <= {TEST + REFERENCE} THEN 'reference' ELSE 'calibration' END AS role,
    CASE WHEN rn <= {TEST} THEN rn WHEN rn <= {TEST + REFERENCE} THEN rn - {TEST} ELSE rn - {TEST + REFERENCE} END AS ord, vec_id AS name, CAST(NULL AS VARCHAR) AS grp
  FROM pos WHERE rn <= {TEST + REFERENCE + CALIBRATION}
  UNION ALL
  SELECT 'negative', CASE WHEN rn <= round_even(n * {TEST_FRACTION}, 0) THEN 'test' ELSE 'setup' END, rn, vec_id, CAST(label AS VARCHAR) FROM neg),
refs AS (SELECT r.name AS ref, r.ord AS ref_ord, u.u AS ru FROM roles r JOIN unit u ON u.vec_id = r.name WHERE r.role = 'reference'),
pairs AS (
  SELECT r.dataset AS kind, r.role, r.name, r.grp, ref, ref_ord, round(list_dot_product(u.u, ru), 9) AS sim,
    row_number() OVER (PARTITION BY r.name ORDER BY round(list_dot_product(u.u, ru), 9) DESC, ref_ord) AS rn
  FROM roles r JOIN unit u ON u.vec_id = r.name CROSS JOIN refs WHERE r.role <> 'reference'),
scored AS (
  SELECT kind, role, name, any_value(grp) AS grp, max(sim) AS score_max, round(avg(sim) FILTER (WHERE rn <= 3), 9) AS score_mean_top3, max(ref) FILTER (WHERE rn = 1) AS best_match,
    coalesce(any_value(grp), '') IN ({_HARD}) AS hard
  FROM pairs GROUP BY kind, role, name),
setup AS (SELECT *, score_max AS score FROM scored WHERE role IN ('calibration', 'setup')),
test AS (SELECT *, score_max AS score FROM scored WHERE role = 'test'),
bounds AS (SELECT min(score) AS low, max(score) AS high FROM setup),
grid AS (SELECT round(k * CAST({STEP} AS DOUBLE), 10) AS cutoff FROM (SELECT unnest(range(CAST(floor(low / {STEP}) AS BIGINT), CAST(ceil(high / {STEP}) AS BIGINT) + 1)) AS k FROM bounds))
"""

_STATS = "count(score) AS n, round(avg(score), 9) AS mean, round(min(score), 12) AS min, round(quantile_cont(score, 0.5), 12) AS p50, round(quantile_cont(score, 0.95), 12) AS p95, round(max(score), 12) AS max"
_NEG, _POS = "kind = 'negative'", "kind = 'positive'"


def _rates(cutoff: str, digits: bool = True) -> str:
    share = lambda where: f"avg(CASE WHEN score >= {cutoff} THEN 1.0 ELSE 0.0 END) FILTER (WHERE {where})"
    show = lambda c: f"round({c}, 12)" if digits else c
    return (
        f"{show(share(_NEG))} AS fpr_overall, {show(share(_NEG + ' AND hard'))} AS fpr_hard, {show(share(_NEG + ' AND NOT hard'))} AS fpr_easy, {show(share(_POS))} AS recall"
    )


def _confusion(table: str, threshold: float) -> str:
    return f"SELECT count(*) FILTER (WHERE {_POS} AND score >= {threshold}) AS tp, count(*) FILTER (WHERE {_POS} AND score < {threshold}) AS fn, count(*) FILTER (WHERE {_NEG} AND score >= {threshold}) AS fp, count(*) FILTER (WHERE {_NEG} AND score < {threshold}) AS tn FROM {table}"


_CANDIDATES = f""",
d AS (SELECT DISTINCT score FROM setup),
cuts AS (
  SELECT (score + lead(score) OVER (ORDER BY score)) / 2 AS cutoff FROM d
  UNION ALL SELECT min(score) - 0.001 FROM d UNION ALL SELECT max(score) + 0.001 FROM d),
rates AS (SELECT cutoff, {_rates("cutoff", digits=False)} FROM setup CROSS JOIN (SELECT cutoff FROM cuts WHERE cutoff IS NOT NULL) GROUP BY cutoff)
"""
_PICKED = "SELECT round(cutoff, 12) AS cutoff, round(recall, 12) AS recall, round(fpr_overall, 12) AS fpr_overall, round(fpr_hard, 12) AS fpr_hard FROM rates "
_TEXT = lambda c: f"CAST({c} AS VARCHAR)"

SQL = {
    "l2_normalize": "SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(embedding[i] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12), 9) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "cosine_scores": BASE + "SELECT name, ref AS reference, round(sim, 12) AS sim FROM pairs",
    "best_match_max": BASE + "SELECT name, kind, role, round(score_max, 12) AS score, best_match FROM scored",
    "best_match_blocks": BASE + "SELECT name, kind, role, round(score_mean_top3, 12) AS score, best_match FROM scored UNION ALL SELECT name, kind, role, round(score_mean_top3, 12), best_match FROM scored",
    "best_match_mean_top3": BASE + "SELECT name, kind, role, round(score_mean_top3, 12) AS score, best_match FROM scored",
    "verdict_margin": BASE + f"SELECT name, score_max >= {THRESHOLD} AS hit, round(score_max - {THRESHOLD}, 12) AS margin FROM scored",
    "split_test_first": BASE + f"SELECT vec_id AS name, rn AS shuffle_rank, rn <= {TEST} AS is_test FROM pos",
    "split_stratified": BASE + 'SELECT name, CAST(grp AS INTEGER) AS "group", role, ord FROM roles WHERE dataset = \'negative\'',
    "split_prefer": BASE + f"SELECT vec_id AS name, row_number() OVER (ORDER BY vec_id % 2 = 0 DESC, rn) AS setup_rank FROM pos WHERE rn > {TEST}",
    "split_roles": BASE + "SELECT dataset, role, count(*) AS n, count(DISTINCT name) AS names FROM roles GROUP BY dataset, role",
    "group_counts": 'SELECT label AS "group", count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY label',
    "sample_per_group": BASE + 'SELECT vec_id AS name, label AS "group" FROM neg WHERE rn <= 7',
    "role_overlap": BASE + "SELECT dataset, CAST(name AS VARCHAR) AS name, count(*) AS n, count(DISTINCT role) AS roles FROM (SELECT dataset, role, name FROM roles UNION ALL SELECT dataset, 'extra', name FROM roles WHERE name % 10 = 0) GROUP BY dataset, name HAVING count(*) > 1",
    "score_summary": BASE + f"SELECT kind, role, {_STATS} FROM (SELECT *, score_max AS score FROM scored) GROUP BY kind, role",
    "hard_easy_stats": BASE + f"SELECT hard AS is_hard, {_STATS}, count(DISTINCT grp) + max(CASE WHEN grp IS NULL THEN 1 ELSE 0 END) AS groups FROM setup WHERE {_NEG} GROUP BY hard",
    "group_stats": BASE + f'SELECT grp AS "group", {_STATS} FROM setup WHERE {_NEG} GROUP BY grp',
    "overlap_report": BASE + f""",
low AS (SELECT name AS ln, score AS ls FROM setup WHERE {_POS} ORDER BY score, name LIMIT 1), high AS (SELECT name AS hn, score AS hs FROM setup WHERE {_NEG} ORDER BY score DESC, name LIMIT 1)
SELECT ln AS lowest_positive, round(ls, 12) AS lowest_score, hn AS highest_negative, round(hs, 12) AS highest_score, round(ls - hs, 12) AS gap,
  count(*) FILTER (WHERE {_NEG} AND score >= ls) AS negatives_over, count(*) FILTER (WHERE {_POS} AND score <= hs) AS positives_under FROM setup, low, high GROUP BY ALL""",
    "sweep_grid": BASE + "SELECT cutoff FROM grid",
    "threshold_sweep": BASE + f"SELECT round(cutoff, 12) AS cutoff, {_rates('cutoff')} FROM setup CROSS JOIN grid GROUP BY cutoff",
    "group_sweep": BASE + f'SELECT grp AS "group", round(cutoff, 12) AS cutoff, round(avg(CASE WHEN score >= cutoff THEN 1.0 ELSE 0.0 END), 12) AS fpr, round(max(score), 12) AS max_score FROM setup CROSS JOIN grid WHERE {_NEG} GROUP BY grp, cutoff',
    "group_fpr_table": BASE + f'SELECT grp AS "group", round(avg(CASE WHEN score >= {THRESHOLD} THEN 1.0 ELSE 0.0 END), 12) AS fpr, count(*) AS n FROM setup WHERE {_NEG} GROUP BY grp',
    "confusion": BASE + _confusion("test", THRESHOLD),
    "fixed_rates": BASE + f"SELECT {_rates(str(THRESHOLD))} FROM test",
    "single_group_fpr": BASE + f"SELECT round(avg(CASE WHEN score >= {THRESHOLD} THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_NEG} AND grp = '1'), 12) AS fpr, count(*) FILTER (WHERE {_NEG} AND grp = '1') AS n FROM test",
    "risk_negatives": BASE + f'SELECT name, round(score, 12) AS score, best_match, grp AS "group" FROM setup WHERE {_NEG} ORDER BY setup.score DESC, name LIMIT 10',
    "risk_positives": BASE + f"SELECT name, round(score, 12) AS score, best_match FROM setup WHERE {_POS} ORDER BY setup.score, name LIMIT 10",
    "false_positives": BASE + f'SELECT name, round(score, 12) AS score, best_match, grp AS "group" FROM test WHERE {_NEG} AND score >= {THRESHOLD}',
    "false_negatives": BASE + f"SELECT name, round(score, 12) AS score, best_match FROM test WHERE {_POS} AND score < {THRESHOLD}",
    "scores_export": BASE + f"SELECT row_number() OVER (ORDER BY CASE WHEN {_NEG} THEN 0 ELSE 1 END, CASE WHEN {_NEG} THEN -score ELSE score END, name) AS place, kind, name, round(score, 12) AS score, CASE WHEN score >= {THRESHOLD} THEN 'hit' ELSE 'miss' END AS verdict, best_match, grp AS \"group\" FROM test",
    "candidate_cutoffs": BASE + _CANDIDATES + "SELECT round(cutoff, 12) AS cutoff, round(recall, 12) AS recall, round(fpr_overall, 12) AS fpr_overall, round(fpr_hard, 12) AS fpr_hard FROM rates",
    "pick_target_fpr_hard": BASE + _CANDIDATES + _PICKED + "WHERE rates.fpr_hard <= 0.05 ORDER BY rates.cutoff LIMIT 1",
    "pick_target_fpr_overall": BASE + _CANDIDATES + _PICKED + "WHERE rates.fpr_overall <= 0.05 ORDER BY rates.cutoff LIMIT 1",
    "pick_youdens_j": BASE + _CANDIDATES + _PICKED + "ORDER BY round(rates.recall - rates.fpr_overall, 12) DESC, rates.cutoff DESC LIMIT 1",
    "pick_equal_error": BASE + _CANDIDATES + _PICKED + "ORDER BY round(abs(rates.fpr_overall - (1 - rates.recall)), 12), rates.cutoff DESC LIMIT 1",
    "drift_table": BASE + f""",
a AS (SELECT {_rates(str(THRESHOLD))} FROM setup), b AS (SELECT {_rates(str(THRESHOLD))} FROM test),
sides AS (
  SELECT 'fpr_overall' AS metric, a.fpr_overall AS calibration, b.fpr_overall AS test FROM a, b UNION ALL SELECT 'fpr_hard', a.fpr_hard, b.fpr_hard FROM a, b
  UNION ALL SELECT 'fpr_easy', a.fpr_easy, b.fpr_easy FROM a, b UNION ALL SELECT 'recall', a.recall, b.recall FROM a, b)
SELECT metric, calibration, test, round(test - calibration, 12) AS change FROM sides""",
    "external_confusion": BASE + _confusion(f"(SELECT * FROM test WHERE {_POS} UNION ALL SELECT *, score_max AS score FROM scored WHERE {_NEG})", THRESHOLD),
    "same_experiment": BASE + f""",
other AS (SELECT vec_id AS name FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('{SEED + 1}:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM embeddings WHERE label = 0) WHERE rn BETWEEN {TEST + 1} AND {TEST + REFERENCE}),
differ AS (SELECT count(*) AS n FROM (SELECT ref AS name FROM refs EXCEPT SELECT name FROM other))
SELECT 'same seed' AS "case", true AS same, 0 AS differ UNION ALL SELECT 'other seed', n = 0, 2 * n FROM differ UNION ALL SELECT 'altered', false, 2""",
    "external_rates": BASE + f"SELECT {_rates(str(THRESHOLD)).replace('hard', 'outer_hard').replace('fpr_outer_hard', 'fpr_hard')} FROM (SELECT kind, score_max AS score, coalesce(grp, '') IN ('4', '5') AS outer_hard FROM scored WHERE {_NEG} OR role = 'test')",
    "detections_with_notes": "SELECT page_id AS image, url, text AS notes FROM pages LEFT JOIN conversations ON page_id = conv_id",
    "keyed_lookup": 'SELECT CAST(label AS VARCHAR) AS "group", CAST(vec_id % 20 AS VARCHAR) AS name, round(CAST(max_by(embedding[1], vec_id) AS DOUBLE), 12) AS x0, round(CAST(max_by(embedding[2], vec_id) AS DOUBLE), 12) AS x1 FROM embeddings GROUP BY label, vec_id % 20',
    "detections_with_crops": """
WITH d AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS place, l_quantity FROM lineitem),
c AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS place, l_partkey FROM lineitem)
SELECT image, CAST(place AS INTEGER) AS place, CAST(l_quantity AS DOUBLE) AS quantity, l_partkey AS crop FROM d JOIN c USING (image, place)""",
    "embed_batches": "SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN NULL ELSE 8 END AS dim, CASE WHEN html IS NULL OR html = '' THEN 'corrupt' ELSE 'ok' END AS status FROM pages",
    "picture_pass": """
WITH p AS (SELECT page_id, encode(html) AS raw, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
b AS (SELECT *, n % 4 AS k, n % 40 AS x, n % 30 AS y FROM p),
c AS (SELECT *, x + 20 + 10 * (k - 1) AS r, CAST(round_even((20 + 10 * (k - 1)) * 0.1, 0) AS BIGINT) AS dx FROM b),
e AS (SELECT *, greatest(x - dx, 0) AS l, least(r + dx, n) AS h FROM c),
s AS (SELECT *, CASE WHEN n = 0 OR (k > 0 AND h <= l) THEN 'corrupt' WHEN k = 0 THEN 'no_detection' ELSE 'ok' END AS status FROM e)
SELECT page_id, status, CASE WHEN status = 'ok' THEN 1 END AS detection_index, CASE WHEN status = 'ok' THEN round(0.3 * k, 12)::DOUBLE END AS confidence, CASE WHEN status = 'ok' THEN x::INTEGER END AS x1,
  CASE WHEN status = 'ok' THEN y::INTEGER END AS y1, CASE WHEN status = 'ok' THEN r::INTEGER END AS x2, CASE WHEN status = 'ok' THEN (y + 10)::INTEGER END AS y2, CASE WHEN status = 'ok' THEN (h - l)::DOUBLE END AS size,
  CASE WHEN status = 'ok' THEN CAST(('0x' || substr(hex(raw), 2 * l + 1, 2)) AS INTEGER)::DOUBLE END AS first
FROM s""",
    "catalog_misses": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "attribute_left_join": "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "pose_lookup": BASE + "SELECT name, best_match, coalesce(p_brand, '') AS position, coalesce(p_type, '') AS view FROM scored LEFT JOIN part ON p_partkey * 2 = best_match",
    "page_of_misses": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY source, doc_id LIMIT 24 OFFSET 24",
    "page_after_key": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY source, doc_id LIMIT 24 OFFSET 48",
    "crop_geometry": """
WITH b AS (SELECT p_partkey, CAST(p_partkey % 90 AS INTEGER) AS x1, CAST(p_partkey % 70 AS INTEGER) AS y1, CAST(p_partkey % 90 + p_size AS INTEGER) AS x2, CAST(p_partkey % 70 + 2 * p_size AS INTEGER) AS y2 FROM part)
SELECT p_partkey, greatest(0, x1 - CAST(round_even((x2 - x1) * 0.1, 0) AS INTEGER)) AS "left", greatest(0, y1 - CAST(round_even((y2 - y1) * 0.1, 0) AS INTEGER)) AS top,
  least(120, x2 + CAST(round_even((x2 - x1) * 0.1, 0) AS INTEGER)) AS "right", least(150, y2 + CAST(round_even((y2 - y1) * 0.1, 0) AS INTEGER)) AS bottom,
  round((x2 - x1) * (y2 - y1) / 18000.0, 12) AS area_fraction FROM b""",
    "detection_rollup": """
WITH d AS (SELECT o_custkey AS image, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, CAST(o_orderkey % 97 AS DOUBLE) / 100 AS area_fraction FROM orders),
per AS (SELECT image, count(*) AS n, max(confidence) AS confidence, max(area_fraction) AS area FROM d GROUP BY 1),
a AS (SELECT i.image, coalesce(n, 0) AS n, confidence, area FROM (SELECT c_custkey AS image FROM customer) i LEFT JOIN per USING (image))
SELECT count(*) AS images, count(*) FILTER (WHERE n = 0) AS none, count(*) FILTER (WHERE n > 1) AS several, count(*) FILTER (WHERE n > 0 AND confidence < 0.8) AS low_confidence,
  count(*) FILTER (WHERE n > 0 AND area > 0.9) AS full_frame, count(*) FILTER (WHERE n = 1 AND NOT confidence < 0.8) AS clean, CAST(sum(n) AS BIGINT) AS crops FROM a""",
    "detection_rank": """
SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS INTEGER) AS detection_index FROM lineitem""",
    "filename_group": "SELECT page_id, regexp_replace(replace(url, '/', '_'), '_[^_]*$', '') AS grp FROM pages",
    "any_crop_hit": BASE + f"""
SELECT image_id, count(name) AS crops, coalesce(bool_or(score_max >= {THRESHOLD}), false) AS hit, round(max(score_max), 12) AS best_score,
  CASE WHEN count(name) = 0 THEN 'no_crop' WHEN bool_or(score_max >= {THRESHOLD}) THEN 'hit' ELSE 'miss' END AS status
FROM (SELECT c_custkey AS image_id FROM customer) LEFT JOIN scored ON name // 3 = image_id GROUP BY image_id""",
    "variant_key": """
SELECT p_brand AS model_id, p_size % 2 = 0 AS detect, CASE WHEN p_size % 2 = 0 THEN p_size % 3 * CAST(0.1 AS DOUBLE) END AS margin, count(*) AS n FROM part GROUP BY ALL""",
    "status_counts": "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
}
SQL["aggregation_winner"] = BASE + f""",
s AS (SELECT 'max' AS aggregation, kind, hard, score_max AS score FROM setup UNION ALL SELECT 'mean-top3', kind, hard, score_mean_top3 FROM setup),
h AS (SELECT aggregation, {_rates(str(THRESHOLD))} FROM s GROUP BY aggregation)
SELECT aggregation, fpr_overall, fpr_hard, fpr_easy, recall FROM h ORDER BY coalesce(fpr_hard, fpr_overall), recall DESC, CASE aggregation WHEN 'max' THEN 0 ELSE 1 END LIMIT 1"""
