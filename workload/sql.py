"""SQL views shared by all oracle texts, and small text helpers."""

from __future__ import annotations


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST(({a}) AS DOUBLE) / ({b}) END)"


def f1(p: str, r: str) -> str:
    return ratio(f"2.0 * ({p}) * ({r})", f"({p}) + ({r})")


_P, _R = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
_CP, _CR = ratio("tp", "picked"), ratio("tp", "support")

BINARY = f"""
  {ratio("tp + tn", "tp + tn + fp + fn")} AS accuracy,
  {_P} AS "precision", {_R} AS recall, {f1(_P, _R)} AS f1"""

COUNT4 = """
  CAST(count(*) FILTER (is_safe AND actual_safe) AS BIGINT) AS tp,
  CAST(count(*) FILTER (NOT is_safe AND NOT actual_safe) AS BIGINT) AS tn,
  CAST(count(*) FILTER (is_safe AND NOT actual_safe) AS BIGINT) AS fp,
  CAST(count(*) FILTER (NOT is_safe AND actual_safe) AS BIGINT) AS fn"""


def latency(source: str, value: str = "latency") -> str:
    return (
        f"SELECT model_name, avg({value}) AS mean, median({value}) AS median, "
        f"stddev_pop({value}) AS std, min({value}) AS min, max({value}) AS max "
        f"FROM {source} GROUP BY model_name"
    )


VIEWS = f"""
WITH v_requests AS (
  SELECT d.doc_id AS instance_index, d.text, d.n_chars, d.lang, d.source,
    CASE WHEN l.toxic = 1 THEN 'unethical' WHEN l.quality = 0 THEN 'off-topic' ELSE 'safe' END AS category
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
v_all_requests AS (
  SELECT d.doc_id AS instance_index, d.text, d.n_chars, d.lang, d.source,
    CASE WHEN l.toxic = 1 THEN 'unethical' WHEN l.quality = 0 THEN 'off-topic' ELSE 'safe' END AS category
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
v_prompts AS (
  SELECT coalesce(d.doc_id, o.o_orderkey) AS instance_index, d.text, d.lang
  FROM documents d FULL JOIN orders o ON d.doc_id = o.o_orderkey
),
v_models(model_name, ord) AS (VALUES ('model_a', 0), ('model_b', 1), ('model_c', 2)),
v_iters(iteration) AS (VALUES (0), (1), (2), (3), (4)),
v_classes(class, pos) AS (VALUES ('safe', 1), ('unethical', 2), ('off-topic', 3)),
v_slots AS (
  SELECT m.model_name, m.ord, i.iteration, r.instance_index, r.n_chars, r.category,
    (r.instance_index * 31 + i.iteration * 17 + m.ord * 7 + r.n_chars) % 20 AS h
  FROM v_requests r CROSS JOIN v_models m CROSS JOIN v_iters i
),
v_responses AS (
  SELECT model_name, ord, instance_index, iteration, h, n_chars, category AS actual,
    CASE WHEN h <= 11 THEN category WHEN h <= 14 THEN 'safe' WHEN h <= 16 THEN 'unethical'
         WHEN h = 17 THEN 'off-topic' END AS predicted,
    CASE WHEN h <= 11 THEN category = 'safe' WHEN h <= 14 THEN true WHEN h <= 17 THEN false
         ELSE instance_index % 2 = 0 END AS is_safe,
    category = 'safe' AS actual_safe,
    CAST(50 + (n_chars * 13 + iteration * 29 + ord * 101) % 1000 AS DOUBLE) AS latency,
    1704067200 + instance_index * 5 + iteration AS ts_s
  FROM v_slots WHERE h <> 19
),
v_all_slots AS (
  SELECT m.model_name, m.ord, i.iteration, r.instance_index, r.n_chars, r.category,
    (r.instance_index * 31 + i.iteration * 17 + m.ord * 7 + r.n_chars) % 20 AS h
  FROM v_all_requests r CROSS JOIN v_models m CROSS JOIN v_iters i
),
v_all_responses AS (
  SELECT model_name, ord, instance_index, iteration, h, n_chars, category AS actual,
    CASE WHEN h <= 11 THEN category WHEN h <= 14 THEN 'safe' WHEN h <= 16 THEN 'unethical'
         WHEN h = 17 THEN 'off-topic' END AS predicted,
    CASE WHEN h <= 11 THEN category = 'safe' WHEN h <= 14 THEN true WHEN h <= 17 THEN false
         ELSE instance_index % 2 = 0 END AS is_safe,
    category = 'safe' AS actual_safe,
    CAST(50 + (n_chars * 13 + iteration * 29 + ord * 101) % 1000 AS DOUBLE) AS latency,
    1704067200 + instance_index * 5 + iteration AS ts_s
  FROM v_all_slots WHERE h <> 19
),
v_binary AS (SELECT model_name, {COUNT4} FROM v_responses GROUP BY model_name),
v_binary_iter AS (SELECT model_name, iteration, {COUNT4} FROM v_responses GROUP BY model_name, iteration),
v_binary_iter_metrics AS (SELECT *, {BINARY} FROM v_binary_iter),
v_cells AS (
  SELECT g.model_name, a.class AS actual, p.class AS predicted, CAST(count(r.model_name) AS BIGINT) AS n
  FROM (SELECT DISTINCT model_name FROM v_responses) g CROSS JOIN v_classes a CROSS JOIN v_classes p
  LEFT JOIN v_responses r ON r.model_name = g.model_name AND r.actual = a.class AND r.predicted = p.class
  GROUP BY ALL
),
v_cells_iter AS (
  SELECT g.model_name, g.iteration, a.class AS actual, p.class AS predicted,
    CAST(count(r.model_name) AS BIGINT) AS n
  FROM (SELECT DISTINCT model_name, iteration FROM v_responses) g
  CROSS JOIN v_classes a CROSS JOIN v_classes p
  LEFT JOIN v_responses r ON r.model_name = g.model_name AND r.iteration = g.iteration
    AND r.actual = a.class AND r.predicted = p.class
  GROUP BY ALL
),
v_class_counts AS (
  SELECT c.class, m.model_name,
    CAST(sum(CASE WHEN m.actual = c.class AND m.predicted = c.class THEN n ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN m.actual = c.class THEN n ELSE 0 END) AS BIGINT) AS support,
    CAST(sum(CASE WHEN m.predicted = c.class THEN n ELSE 0 END) AS BIGINT) AS picked
  FROM v_cells m CROSS JOIN v_classes c GROUP BY ALL
),
v_class_metrics AS (
  SELECT *, {_CP} AS "precision", {_CR} AS recall, {f1(_CP, _CR)} AS f1 FROM v_class_counts
),
v_class_counts_iter AS (
  SELECT c.class, m.model_name, m.iteration,
    CAST(sum(CASE WHEN m.actual = c.class AND m.predicted = c.class THEN n ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN m.actual = c.class THEN n ELSE 0 END) AS BIGINT) AS support,
    CAST(sum(CASE WHEN m.predicted = c.class THEN n ELSE 0 END) AS BIGINT) AS picked
  FROM v_cells_iter m CROSS JOIN v_classes c GROUP BY ALL
),
v_class_mean AS (
  SELECT model_name, class, avg("precision") AS "precision", avg(recall) AS recall, avg(f1) AS f1
  FROM (SELECT *, {_CP} AS "precision", {_CR} AS recall, {f1(_CP, _CR)} AS f1 FROM v_class_counts_iter)
  GROUP BY model_name, class
),
v_multi AS (
  SELECT model_name,
    CASE WHEN sum(support) = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(sum(tp) AS DOUBLE) / sum(support) END AS accuracy,
    avg("precision") AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    sum("precision" * support) / sum(support) AS weighted_precision,
    sum(recall * support) / sum(support) AS weighted_recall,
    sum(f1 * support) / sum(support) AS weighted_f1
  FROM v_class_metrics GROUP BY model_name
),
v_multi_acc AS (
  SELECT a.model_name, a.macro_precision, a.macro_recall, a.macro_f1, b.micro
  FROM (SELECT model_name, avg("precision") AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1
        FROM v_class_mean GROUP BY model_name) a
  JOIN (SELECT model_name, {ratio("sum(CASE WHEN actual = predicted THEN n ELSE 0 END)", "sum(n)")} AS micro
        FROM v_cells GROUP BY model_name) b ON a.model_name = b.model_name
),
v_binary_acc AS (
  SELECT model_name, macro_accuracy, macro_precision, macro_recall, macro_f1,
    {_P} AS micro_precision, {_R} AS micro_recall, {f1(_P, _R)} AS micro_f1,
    tp / 5.0 AS avg_tp, tn / 5.0 AS avg_tn, fp / 5.0 AS avg_fp, fn / 5.0 AS avg_fn
  FROM (SELECT model_name, avg(accuracy) AS macro_accuracy, avg("precision") AS macro_precision,
          avg(recall) AS macro_recall, avg(f1) AS macro_f1, CAST(sum(tp) AS DOUBLE) AS tp,
          CAST(sum(tn) AS DOUBLE) AS tn, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn
        FROM v_binary_iter_metrics GROUP BY model_name)
),
v_latency AS ({latency("v_responses")}),
v_instance AS (SELECT model_name, instance_index, avg(latency) AS latency FROM v_responses GROUP BY ALL),
v_latency_instance AS ({latency("v_instance")}),
v_all_latency AS ({latency("v_all_responses")}),
v_all_instance AS (SELECT model_name, instance_index, avg(latency) AS latency FROM v_all_responses GROUP BY ALL),
v_all_latency_instance AS ({latency("v_all_instance")}),
v_perf_acc AS (
  SELECT model_name, category, CAST(count(*) AS BIGINT) AS total, sum(acc) AS correct, avg(acc) AS accuracy
  FROM (
    SELECT m.model_name, q.instance_index, q.category,
      CASE WHEN count(r.model_name) = 0 THEN 0.0
           ELSE CAST(count(*) FILTER (r.is_safe = r.actual_safe) AS DOUBLE) / count(r.model_name) END AS acc
    FROM (SELECT DISTINCT model_name FROM v_responses) m CROSS JOIN v_requests q
    LEFT JOIN v_responses r ON r.model_name = m.model_name AND r.instance_index = q.instance_index
    GROUP BY ALL
  ) GROUP BY model_name, category
),
v_events AS (
  SELECT event_type AS model_name, user_id AS instance_index, (event_id * 7 + user_id) % 3 <> 0 AS is_safe,
    value AS latency, ts
  FROM events
),
v_guard_raw AS (
  SELECT model_name, instance_index, iteration,
    CASE WHEN h = 18 THEN 'safe'
         WHEN h < 6 THEN chr(10) || chr(10) || ' safe'
         WHEN h < 10 THEN chr(10) || chr(10) || 'unsafe' || chr(10) || 'A2'
         WHEN h < 13 THEN 'head' || chr(10) || 'meta' || chr(10) || 'unsafe' || chr(10) || 'A3' || chr(10) || 'A1' || chr(10)
         WHEN h < 15 THEN chr(10) || chr(10) || 'unsafe' || chr(10) || 'S2'
         WHEN h < 17 THEN chr(10) || chr(10) || 'unsafe' || chr(10) || 'A1,A3'
         ELSE chr(10) || chr(10) || chr(10) END AS raw_response,
    h
  FROM v_all_responses
),
v_errors AS (
  SELECT model_name, instance_index, iteration, iteration + 1 AS attempt,
    CASE CAST(instance_index % 4 AS INTEGER)
      WHEN 0 THEN '429 RESOURCE_EXHAUSTED. Please retry in ' || CAST(n_chars % 50 AS VARCHAR) || '.5s'
      WHEN 1 THEN 'Quota exceeded for requests per minute'
      WHEN 2 THEN 'Invalid response format from service: missing key'
      ELSE 'Unexpected error during evaluation: Quota exceeded' END AS error
  FROM v_all_slots WHERE h = 19
),
v_log AS (
  SELECT run, ts_s, level, message FROM (
    SELECT model_name || '-' || iteration AS run, min(ts_s) AS ts_s, 'INFO' AS level,
      'Loaded ' || (SELECT count(*) FROM v_all_requests) || ' samples from dataset' AS message
    FROM v_all_responses GROUP BY model_name, iteration
    UNION ALL
    SELECT model_name || '-' || iteration, min(ts_s), 'INFO',
      'Evaluating ' || model_name || ' on ' || (SELECT count(*) FROM v_all_requests) || ' samples'
    FROM v_all_responses GROUP BY model_name, iteration
    UNION ALL
    SELECT model_name || '-' || iteration, max(ts_s) + 60, 'INFO',
      'Completed evaluation. Got ' || count(*) || ' responses'
    FROM v_all_responses GROUP BY model_name, iteration
    UNION ALL
    SELECT model_name || '-' || iteration, 1704067200 + instance_index * 5 + iteration, 'ERROR',
      'Call ' || instance_index || ' failed: ' || error
    FROM v_errors
  )
)
"""
