"""SQL for the oracle engine, written apart from the queries of the same names: other joins, lists, counts and sums for the same results."""

from __future__ import annotations

R = "(SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
M = "(SELECT event_id, event_type AS model, user_id % 4 AS category, user_id % 3 AS ctx, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
STD = "sqrt((sum({x} * {x}) - sum({x}) * sum({x}) / count({x})) / (count({x}) - 1))"


def std(x: str) -> str:
    return STD.replace("{x}", x)


INDEPENDENT = {
    # sequences of a user
    "mask_to_first_stop": f"WITH r AS {R} SELECT event_id, NOT EXISTS (SELECT 1 FROM r p WHERE p.user_id = r.user_id AND p.event_id < r.event_id AND p.k > 95) AS kept FROM r",
    "first_stop_position": f"SELECT user_id, coalesce(list_position(list_transform(ks, lambda x: x > 95), true) - 1, len(ks)) AS stop_at FROM (SELECT user_id, list(k ORDER BY event_id) AS ks FROM {R} GROUP BY user_id)",
    "pad_after_stop": f"WITH r AS {R} SELECT event_id, CASE WHEN r.event_id > coalesce((SELECT min(p.event_id) FROM r p WHERE p.user_id = r.user_id AND p.k > 95), r.event_id) THEN -1 ELSE k END AS token FROM r",
    "whitened_values": f"WITH r AS {R}, s AS (SELECT sum(value) / count(*) AS m, count(*) AS n FROM r), v AS (SELECT m, sum((value - m) * (value - m)) / (any_value(n) - 1) AS v FROM r, s GROUP BY m) SELECT event_id, round((value - m) / sqrt(v + 1e-8), 6) AS w FROM r, v",
    "return_minus_baseline": f"WITH r AS {R} SELECT event_id, round((SELECT sum(p.value) FROM r p WHERE p.user_id = r.user_id AND p.event_id >= r.event_id) - (SELECT sum(p.value) FROM r p WHERE p.user_id = r.user_id) / 8, 7) AS adv FROM r",
    "middle_truncation": f"SELECT unnest(CASE WHEN len(ids) <= 40 THEN ids ELSE ids[1:20] || ids[len(ids) - 19:len(ids)] END) AS event_id FROM (SELECT list(event_id ORDER BY event_id) AS ids FROM {R} GROUP BY user_id)",
    "next_token_pairs": f"WITH s AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM {R}) SELECT a.k, b.k AS nxt, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND b.p = a.p + 1 GROUP BY a.k, b.k",
    "running_moments_by_batch": f"WITH r AS (SELECT event_id // 100 AS batch, value FROM {R}) SELECT b.batch, round(sum(r.value) / (count(*) + 1e-3), 6) AS mean, round(var_samp(r.value), 4) AS variance FROM (SELECT DISTINCT batch FROM r) b JOIN r ON r.batch <= b.batch GROUP BY b.batch",
    # joins and sets
    "lookup_by_id": "SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS c_name FROM orders",
    "lookup_one_to_many": "SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey",
    "anti_join_judged": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
    "semi_join_split": "SELECT doc_id, quality > 0 AS relevant FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "skip_reasons": "SELECT 'toxic' AS reason, count(*) AS n FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents) HAVING count(*) > 0 UNION ALL SELECT 'usable', count(*) FROM labels WHERE toxic = 0 AND doc_id IN (SELECT doc_id FROM documents) HAVING count(*) > 0 UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) HAVING count(*) > 0",
    "union_rows": "SELECT unnest(ids) AS id, kind FROM (SELECT list(doc_id) AS ids, 'd' AS kind FROM documents UNION ALL SELECT list(page_id), 'p' FROM pages)",
    "horizontal_concat": "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "resample_weights": "SELECT e.event_id, round(sqrt(e.value) / s.total, 9) AS weight FROM events e JOIN (SELECT event_type, sum(sqrt(value)) AS total FROM events GROUP BY event_type) s USING (event_type)",
    "chunk_ids": "SELECT event_id, event_id // 128 AS chunk FROM events",
    "count_windows": "SELECT event_id // 64 AS win, CAST(64 AS BIGINT) AS n, round(sum(value) / 64, 6) AS mean FROM events GROUP BY 1 HAVING count(*) = 64",
    "strided_rows": "SELECT event_id, value FROM events WHERE event_id IN (SELECT unnest(range(10, 901, 7)))",
    "cyclic_padding": "SELECT doc_id, unnest(CASE WHEN row_number() OVER (ORDER BY doc_id) <= 24 THEN [false, true] ELSE [false] END) AS padded FROM documents",
    "drop_padding": "SELECT event_id FROM events WHERE event_id NOT IN (SELECT unnest(range((SELECT max(event_id) FROM events) - 6, (SELECT max(event_id) FROM events) + 1)))",
    "unpivot_preference": "SELECT conv_id, turn = 1 AS label, md5(text) AS digest FROM conversations WHERE turn IN (0, 1)",
    "not_all_same": "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1",
    "token_budget_prefix": "SELECT source, count(*) AS kept FROM documents d WHERE (SELECT sum(n_chars) FROM documents p WHERE p.source = d.source AND p.doc_id <= d.doc_id) <= 20000 GROUP BY source",
    "renamed_roles": "SELECT conv_id, turn, coalesce(map {'user': 'human', 'assistant': 'gpt'}[role], role) AS speaker FROM conversations",
    "question_position": "SELECT item_id, md5(replace(['@ Q', 'Q @', 'Q @ Q'][CAST(item_id % 3 + 1 AS INT)], '@', text)) AS digest FROM benchmark",
    "demo_formats": "SELECT doc_id, lang || [' | ', ' -> ', ' (', ': '][CAST(doc_id % 4 + 1 AS INT)] || source || CASE WHEN doc_id % 4 = 2 THEN ')' ELSE '' END AS demo FROM documents",
    "level_filter": "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[2-4]$') AND NOT contains(p_type, 'STEEL')",
    "loss_mask": "SELECT conv_id, coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS trained, coalesce(CAST(sum(length(text)) FILTER (WHERE role <> 'assistant') AS BIGINT), 0) AS ignored FROM conversations GROUP BY conv_id",
    "control_prefix": "SELECT doc_id, md5(CASE WHEN starts_with(text, 'Section::::') THEN substr(text, 12) WHEN starts_with(text, 'BULLET::::') THEN substr(text, 11) WHEN starts_with(text, 'NUMBERED::::') THEN substr(text, 13) ELSE text END) AS digest FROM documents",
    # aggregates
    "metric_means": f"SELECT model, round(sum(value) / count(value), 6) AS score, round(sum(k) * 1e0 / count(k), 6) AS length, round(avg(value) FILTER (WHERE k > 50), 6) AS long_score, count(*) AS n FROM {M} GROUP BY model",
    "mean_by_category_ctx": f"SELECT DISTINCT model, category, ctx, round(avg(value) OVER (PARTITION BY model, category, ctx), 6) AS score FROM {M}",
    "short_long_wide": f"SELECT model, category, round(avg(value) FILTER (WHERE ctx < 2), 6) AS short_score, round(avg(value) FILTER (WHERE ctx = 2), 6) AS long_score FROM {M} GROUP BY model, category",
    "mean_and_std": f"SELECT model, round(sum(value) / count(*), 6) AS mean_value, round({std('value')}, 6) AS std_value, round(sum(k) * 1e0 / count(*), 6) AS mean_k, round({std('(k * 1e0)')}, 6) AS std_k FROM {M} GROUP BY model",
    "column_override": f"SELECT event_id, CAST(k AS DOUBLE) AS score FROM {M} WHERE model = 'click' UNION ALL SELECT event_id, value FROM {M} WHERE model <> 'click'",
    "mean_of_row_means": f"SELECT category, round(sum(s / n) / count(*), 6) AS score FROM (SELECT category, user_id, sum(value) AS s, count(*) AS n FROM {M} GROUP BY category, user_id) GROUP BY category",
    "ms_per_token": f"SELECT model, round(1000 * sum(value) / (sum(k) + CASE WHEN model = 'view' THEN 0 ELSE 10 * count(*) END), 6) AS ms FROM {M} GROUP BY model",
    "tokens_per_second": f"SELECT category, round(sum(k) / sum(value) / 8, 6) AS per_device FROM {M} GROUP BY category",
    "grade_counts": f"SELECT ctx, CAST(grade AS INT) AS grade, sum(n)::BIGINT AS n, count(*) AS queries FROM (SELECT ctx, k % 4 AS grade, user_id, count(*) AS n FROM {M} GROUP BY ALL) GROUP BY ctx, grade",
    "judged_per_query": f"SELECT round(sum(n) * 1e0 / count(*), 6) AS mean_n, min(n) AS min_n, max(n) AS max_n FROM (SELECT user_id, max(p) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id) AS p FROM {M}) GROUP BY user_id)",
    "value_ranges": f"SELECT model, list_min(ks) AS min_k, list_max(ks) AS max_k, round(list_avg(ks), 6) AS mean_k, CAST(len(list_distinct(ks)) AS BIGINT) AS distinct_k FROM (SELECT model, list(k) AS ks FROM {M} GROUP BY model)",
    "top_options": f"WITH c AS (SELECT category, k, count(*) AS n FROM {M} GROUP BY category, k) SELECT category, k AS option_k, n FROM c WHERE (SELECT count(*) FROM c o WHERE o.category = c.category AND (o.n > c.n OR (o.n = c.n AND o.k < c.k))) < 5",
    "threshold_count": f"SELECT category, count(*) FILTER (WHERE value > 20 AND k >= 10 AND k <= 60) AS n FROM {M} GROUP BY category HAVING count(*) FILTER (WHERE value > 20 AND k >= 10 AND k <= 60) > 0",
    "pairwise_accuracy": f"SELECT model, round(count(*) FILTER (WHERE value > k) * 1e0 / count(*) FILTER (WHERE value <> k), 6) AS accuracy, count(*) FILTER (WHERE value <> k) AS n FROM {M} GROUP BY model",
    "nan_skipping": f"SELECT model, round(stddev_samp(value) FILTER (WHERE k % 7 <> 0), 6) AS std, round(min(value) FILTER (WHERE k % 7 <> 0), 6) AS low, round(max(value) FILTER (WHERE k % 7 <> 0), 6) AS high FROM {M} GROUP BY model",
    "masked_sum_mean": f"SELECT model, round(sum(value * m), 4) AS total, round(sum(value * m) / (sum(m) + 1e-8), 6) AS mean FROM (SELECT model, value, CAST(k > 30 AS INT) AS m FROM {M}) GROUP BY model",
    "global_moments": f"SELECT round(sum(s) / sum(n), 6) AS mean, round(max(hi), 6) AS high, round(min(lo), 6) AS low, round(sqrt((sum(q) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1)), 6) AS std FROM (SELECT event_id % 7 AS rank, sum(value) AS s, sum(value * value) AS q, count(*) AS n, max(value) AS hi, min(value) AS lo FROM {M} GROUP BY 1)",
    "partition_spread": f"SELECT list_min(l) AS low, list_max(l) AS high, list_max(l) - list_min(l) AS spread FROM (SELECT list(s) AS l FROM (SELECT CAST(sum(k) AS BIGINT) AS s FROM {M} GROUP BY event_id % 8))",
    "population_moments": f"SELECT model, round(sum(value) / count(*), 6) AS mean, round(avg(value * value) - avg(value) * avg(value), 6) AS variance FROM {M} GROUP BY model",
    "vote_winner": f"SELECT category, arg_max(k, n * 1000000000 - first_at) AS winner FROM (SELECT category, k, count(*) AS n, min(event_id) AS first_at FROM {M} GROUP BY category, k) GROUP BY category",
    "win_rate": f"SELECT model, round(sum(k % 2) * 1e0 / count(*), 6) AS win_rate FROM {M} GROUP BY model",
    "majority_value": f"WITH r AS {M}, c AS (SELECT user_id, model, count(*) AS n, min(event_id) AS a FROM r GROUP BY ALL), m AS (SELECT user_id, arg_max(model, n * 1000000000 - a) AS model FROM c GROUP BY user_id) SELECT r.user_id, arg_min(value, event_id) AS value FROM r JOIN m USING (user_id, model) GROUP BY r.user_id",
    "loss_aggregation": f"WITH r AS {M}, u AS (SELECT user_id, sum(value) AS s, count(*) AS n FROM r GROUP BY user_id) SELECT round(sum(s) / sum(n), 6) AS token_mean, round(sum(s) / count(*), 4) AS seq_mean_token_sum, round(sum(s / (n + 1e-8)) / count(*), 6) AS seq_mean_token_mean, round(sum(s) / 128, 4) AS seq_mean_token_sum_norm FROM u",
    "batch_summary": f"SELECT round(sum(value) / count(*), 6) AS mean_score, round(max(value), 6) AS max_score, round(min(value), 6) AS min_score, round(sum(k) * 1e0 / count(*) FILTER (WHERE k > 0), 6) AS mean_length, round(count(*) FILTER (WHERE k >= 90) * 1e0 / count(*), 6) AS clip_ratio, round(count(*) FILTER (WHERE k = 0) * 1e0 / count(*), 6) AS aborted_ratio FROM {M}",
    "best_n_candidates": "SELECT user_id, unnest(list(event_id ORDER BY value DESC, event_id)[1:3]) AS event_id FROM events GROUP BY user_id",
    "query_max_depth": "SELECT DISTINCT source, max(n_chars) OVER (PARTITION BY source) AS depth FROM documents",
    "quadratic_cost": "SELECT doc_id, CAST(n_chars * (24576 + n_chars) AS BIGINT) AS cost FROM documents",
    # ratios of two policies
    "config_grid": "SELECT CAST(k AS INT) AS k, CAST(v AS INT) AS v, CAST(q AS INT) AS q FROM (SELECT unnest(range(1, (SELECT count(*) FROM region) + 1)) AS k), (SELECT unnest(range(1, (SELECT count(*) FROM region) + 1)) AS v), (SELECT unnest(range(1, (SELECT count(*) FROM region) + 1)) AS q) WHERE NOT (k * v > 16) AND NOT (q > k OR q > 6)",
    # token rows, sets and projections, by counts, lists and set operations
    "step_weighted_baseline": f"""WITH r AS {R}, p AS (SELECT a.event_id, a.event_type, (SELECT count(*) FROM r b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id <= a.event_id) AS pos,
        (SELECT sum(b.value) FROM r b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id >= a.event_id) AS g, (SELECT sum(b.k + 1) FROM r b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id <= a.event_id) AS w FROM r a),
        s AS (SELECT event_type, pos, sum(g * w) AS gw, sum(w) AS ws FROM p GROUP BY ALL) SELECT event_id, round(g - gw / (ws + 1e-8), 5) AS adv FROM p JOIN s USING (event_type, pos)""",
    "rotate_to_first_valid": f"WITH l AS (SELECT list(event_id ORDER BY event_id) AS ids, list_position(list(k % 2 = 1 ORDER BY event_id), true) AS f FROM {R} GROUP BY user_id) SELECT unnest(ids) AS event_id, CASE WHEN f > 0 THEN (generate_subscripts(ids, 1) - f + len(ids)) % len(ids) END AS new_pos FROM l",
    "keep_protected_tokens": f"WITH r AS {R} SELECT event_id FROM r WHERE k > 90 OR (SELECT count(*) FROM r b WHERE b.user_id = r.user_id AND b.k <= 90 AND b.event_id >= r.event_id) <= 30 - (SELECT count(*) FROM r c WHERE c.user_id = r.user_id AND c.k > 90)",
    "next_token_sets": f"WITH l AS (SELECT list(k ORDER BY event_id) AS ks FROM {R} GROUP BY user_id), t AS (SELECT unnest(list_transform(range(1, len(ks) - 1), lambda i: [ks[i], ks[i + 1], ks[i + 2]])) AS x FROM l) SELECT x[1] AS first_token, x[2] AS second_token, x[3] AS next_token, count(*) AS n FROM t GROUP BY ALL",
    "label_filter": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM documents WHERE source IS NULL OR source = '' OR lang IS NULL",
    "inner_with_skip_counts": "SELECT (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS matched, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unmatched",
    "first_per_pid": "SELECT pid, CASE WHEN pid IN (SELECT doc_id % 300 FROM documents) THEN 1 ELSE 2 END AS src FROM (SELECT doc_id % 300 AS pid FROM documents UNION SELECT doc_id % 500 FROM labels)",
    "surrogate_keys": "WITH g AS (SELECT source, lang, min(doc_id) AS f FROM documents GROUP BY ALL) SELECT d.doc_id, (SELECT count(*) FROM g o WHERE o.f < g.f) AS key_id FROM documents d JOIN g USING (source, lang)",
    "rotate_pairs": "SELECT event_id, coalesce((SELECT max(p.event_id) FROM events p WHERE p.event_id // 16 = e.event_id // 16 AND p.event_id < e.event_id), (SELECT max(p.event_id) FROM events p WHERE p.event_id // 16 = e.event_id // 16)) AS partner FROM events e",
    "split_by_year": "SELECT o_orderkey, if(left(CAST(o_orderdate AS VARCHAR), 4) IN ('1996', '1997'), 'train', 'validation') AS split FROM orders",
    "gather_rows": "SELECT turn, conv_id * 5 AS event_id, (SELECT value FROM events WHERE event_id = conv_id * 5) AS value FROM conversations WHERE conv_id * 5 IN (SELECT event_id FROM events)",
    "rename_columns": "SELECT * FROM (SELECT event_id, value, event_type FROM events) t(row_id, score, kind)",
    "column_subset": "SELECT COLUMNS('^(event_id|value)$') FROM events",
    "length_filter": "SELECT conv_id FROM conversations WHERE turn = 0 EXCEPT ALL SELECT conv_id FROM conversations WHERE turn = 0 AND (text IS NULL OR length(text) > 512)",
    "row_mean_of_cells": f"SELECT model, round(sum(s / n) / count(*), 6) AS mean_of_means FROM (SELECT model, ctx, sum(value) AS s, count(*) AS n FROM {M} GROUP BY ALL) GROUP BY model",
    "reduce_by_name": f"SELECT 'loss_' || model AS name, round(sum(value) / count(*), 6) AS x FROM {M} GROUP BY model UNION ALL SELECT 'max_' || model, round(list_max(list(value)), 6) FROM {M} GROUP BY model UNION ALL SELECT 'minibatch_' || model, round(list_min(list(value)), 6) FROM {M} GROUP BY model",
    "gradient_proxy": f"SELECT category, round(sum(pow(value, 2) * k) / count(*), 4) AS total_power, round(pow(sum(value) / count(*), 2), 6) AS signal_power FROM {M} GROUP BY category",
    "threshold_argmax": f"WITH m AS (SELECT * FROM {M} WHERE k >= 10 AND k <= 60) SELECT category, event_id, value FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.category = m.category AND (o.value > m.value OR (o.value = m.value AND o.event_id < m.event_id)))",
    "masked_variance": f"SELECT model, round(var_samp(value), 4) AS variance FROM {M} WHERE k > 30 GROUP BY model HAVING count(*) > 1",
    "core_metrics": f"SELECT concat('mean@', ctx, '/', model) AS name, round(sum(value) / count(*), 6) AS x FROM {M} WHERE ctx = (SELECT max(ctx) FROM {M}) GROUP BY ctx, model",
    "reward_vector": f"SELECT event_id, round(if(k > 20, value, 0) * 0.5e0 + if(k > 40, k, 0) * 0.3e0 + if(ctx = 1, 0.2e0, 0), 6) AS reward, NOT (k > 20 OR ctx = 1) AS none_applies FROM {M}",
    "integer_thirds": "SELECT doc_id, (doc_id + 2) // 3 AS dense, (doc_id + 1) // 3 AS sparse, doc_id // 3 AS rest FROM documents",
    "over_fetch": "SELECT doc_id, (8 * doc_id + 4) // 5 AS depth FROM documents",
}
