"""DuckDB SQL: the traces and steps of the tables at hand, written apart from the engine's own plans."""

BASE = """
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS trace_id
  FROM events),
e2 AS (
  SELECT *, 'agent-' || CAST(event_id % 3 AS VARCHAR) AS mine, 'agent-' || CAST((event_id + 1) % 3 AS VARCHAR) AS other,
         CASE WHEN event_type = 'click' AND k % 9 = 0 THEN 'message'
              WHEN event_type = 'view' AND k % 10 = 1 THEN 'response'
              WHEN event_type = 'view' AND k % 10 = 2 THEN 'plan'
              WHEN event_type = 'error' AND k % 4 = 0 THEN 'error'
              ELSE 'tool_call' END AS kind,
         CASE event_type WHEN 'view' THEN 'get_item' WHEN 'click' THEN 'search_items' WHEN 'purchase' THEN 'place_order'
              WHEN 'signup' THEN 'create_account' WHEN 'error' THEN 'call_api' END AS named,
         'handle user ' || CAST(user_id AS VARCHAR) || CASE WHEN user_id % 7 = 0 THEN ' or ask whether either will do' ELSE '' END AS task,
         CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step_index
  FROM ev),
e3 AS (
  SELECT *, CASE kind WHEN 'message' THEN mine || '->' || other WHEN 'tool_call' THEN named END AS tool,
         '{"k": ' || CAST(k % 10 AS VARCHAR) || '}' AS args_canon
  FROM e2),
steps AS (
  SELECT trace_id, 'store-' || CAST(user_id % 3 AS VARCHAR) AS store, step_index, user_id, event_id, ts, epoch_us(ts) AS ts_us, k, kind, tool, args_canon,
         'item #c-' || CAST(k % 10 AS VARCHAR) AS result,
         CASE WHEN kind = 'plan' THEN CASE WHEN k % 4 = 0 THEN task ELSE 'plan the next move' END
              WHEN kind = 'tool_call' AND k % 7 = 3 THEN 'now call search_items'
              WHEN kind = 'response' THEN 'as noted in #c-' || CAST((k + 3) % 10 AS VARCHAR) END AS thought,
         k AS tokens, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'boom' END AS error,
         CASE WHEN k % 17 <> 0 THEN mine END AS agent,
         CASE WHEN kind = 'message' THEN mine END AS from_agent, CASE WHEN kind = 'message' THEN other END AS to_agent,
         kind = 'message' AND k % 2 = 1 AS requires_ack,
         CASE WHEN kind = 'tool_call' AND k % 13 = 0 THEN 'agent-1' END AS share_with,
         kind = 'tool_call' AND event_type IN ('purchase', 'signup') AS mutating,
         task, 'm' || CAST(user_id % 3 AS VARCHAR) AS model,
         kind || ':' || coalesce(tool, 'None') || ':' || args_canon AS fingerprint,
         kind = 'tool_call' AND named = 'get_item' AS is_verify
  FROM e3),
traces AS (
  SELECT trace_id, any_value(store) AS store, any_value(user_id) AS user_id, any_value(task) AS task, any_value(model) AS model,
         min(ts_us) AS created_us, count(*) AS n_steps, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(latency_ms) AS BIGINT) AS duration,
         arg_max(kind, step_index) AS last_kind, max(step_index) AS last_index,
         CASE WHEN any_value(user_id) % 11 = 0 THEN NULL ELSE NOT (arg_max(kind, step_index) = 'error' OR any_value(user_id) % 4 = 0) END AS success,
         any_value(user_id) % 8 = 0 AS breached, any_value(user_id) % 10 = 0 AS annotated,
         CASE WHEN any_value(user_id) % 3 = 0 THEN 12 END AS step_limit,
         CASE WHEN any_value(user_id) % 5 = 0 THEN 'create_account' END AS forbidden, any_value(user_id) % 6 = 0 AS roles
  FROM steps GROUP BY trace_id),
prices AS (SELECT * FROM (VALUES ('m0', 0.01), ('m1', 0.02)) p(model, rate))
"""

#: First hit of each rule in each trace: mode_id, rule, trace_id, step_index, confidence.
RULES = """,
calls AS (SELECT * FROM steps WHERE kind = 'tool_call'),
ok AS (SELECT *, lag(step_index) OVER (PARTITION BY trace_id, fingerprint ORDER BY step_index) AS before FROM calls WHERE error IS NULL),
rep0 AS (SELECT trace_id, before, step_index, fingerprint FROM ok WHERE step_index - before <= 6
         QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY step_index) = 1),
r_repeat AS (SELECT 'FM-1.3' AS mode_id, 'repeat' AS rule, r.trace_id, r.step_index, least(0.95, 0.6 + 0.1 * count(*)) AS confidence
             FROM rep0 r JOIN steps s ON s.trace_id = r.trace_id AND s.fingerprint = r.fingerprint AND s.step_index BETWEEN r.before AND r.step_index
             GROUP BY r.trace_id, r.step_index),
loops AS (SELECT trace_id, fingerprint, count(*) AS n, min(step_index) AS a, max(step_index) AS b FROM ok GROUP BY ALL),
loop1 AS (SELECT trace_id, b FROM loops WHERE n >= 3 AND b - a > 6 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY a) = 1),
r_long AS (SELECT 'FM-1.5' AS mode_id, 'long_loop' AS rule, t.trace_id, coalesce(l.b, t.last_index) AS step_index, CASE WHEN l.b IS NOT NULL THEN 0.65 ELSE 0.6 END AS confidence
           FROM traces t LEFT JOIN loop1 l USING (trace_id) WHERE l.b IS NOT NULL OR (t.n_steps >= t.step_limit AND t.last_kind <> 'response')),
r_reset AS (SELECT 'FM-2.1' AS mode_id, 'reset' AS rule, trace_id, min(step_index) AS step_index, 0.75 AS confidence FROM steps
            WHERE step_index > 0 AND kind = 'plan' AND lower(trim(thought)) = lower(trim(task)) GROUP BY trace_id),
r_early AS (SELECT 'FM-3.1' AS mode_id, 'premature' AS rule, trace_id, last_index AS step_index, CASE last_kind WHEN 'response' THEN 0.7 ELSE 0.8 END AS confidence
            FROM traces WHERE success = false AND last_kind IN ('response', 'error')),
ver AS (SELECT *, min(CASE WHEN is_verify THEN step_index END) OVER (PARTITION BY trace_id ORDER BY step_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_verify FROM steps),
r_unverified AS (SELECT 'FM-3.2' AS mode_id, 'missing_verify' AS rule, trace_id, min(step_index) AS step_index, 0.7 AS confidence FROM ver
                 WHERE mutating AND error IS NULL AND next_verify IS NULL GROUP BY trace_id),
weak AS (SELECT v.trace_id, v.step_index AS claim_at, v.next_verify FROM ver v JOIN steps s ON s.trace_id = v.trace_id AND s.step_index = v.next_verify
         WHERE v.mutating AND v.error IS NULL AND lower(v.result) = lower(coalesce(s.error, s.result))),
r_weak AS (SELECT 'FM-3.3' AS mode_id, 'weak_verify' AS rule, trace_id, next_verify AS step_index, 0.6 AS confidence FROM weak QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY claim_at) = 1),
r_mismatch AS (SELECT 'FM-2.6' AS mode_id, 'intent_mismatch' AS rule, trace_id, min(step_index) AS step_index, 0.65 AS confidence FROM calls
               WHERE thought IS NOT NULL AND tool <> 'search_items' AND thought = 'now call search_items' GROUP BY trace_id),
words AS (SELECT DISTINCT trace_id, unnest(regexp_split_to_array(lower(task), '[^a-z0-9]+')) AS word FROM traces),
keys AS (SELECT trace_id, word FROM words WHERE length(word) > 3 AND word NOT IN ('this', 'that', 'with', 'from', 'then')),
haskeys AS (SELECT DISTINCT trace_id FROM keys),
hit AS (SELECT c.trace_id, c.step_index, bool_or(contains(lower(c.tool) || ' ' || c.args_canon, k.word)) AS on_topic FROM calls c JOIN keys k USING (trace_id) GROUP BY ALL),
r_derail AS (SELECT 'FM-2.3' AS mode_id, 'derail' AS rule, trace_id, min(step_index) FILTER (WHERE NOT on_topic) AS step_index,
                    least(0.55, 0.35 + 0.2 * count(*) FILTER (WHERE NOT on_topic) / count(*)) AS confidence
             FROM hit GROUP BY trace_id HAVING count(*) >= 3 AND count(*) FILTER (WHERE NOT on_topic) >= 0.5 * count(*)),
r_forbidden AS (SELECT 'FM-1.1' AS mode_id, 'forbidden' AS rule, trace_id, min(step_index) AS step_index, 1.0 AS confidence FROM calls JOIN traces USING (trace_id) WHERE calls.tool = forbidden GROUP BY trace_id),
r_clarify AS (SELECT 'FM-2.2' AS mode_id, 'clarify' AS rule, s.trace_id, coalesce(min(CASE WHEN mutating THEN step_index END), max(step_index)) AS step_index, 0.55 AS confidence
              FROM steps s WHERE ((contains(lower(task), ' or ') AND (contains(task, '?') OR contains(lower(task), 'either'))) OR s.user_id % 35 = 3)
              GROUP BY s.trace_id HAVING NOT coalesce(bool_or(contains(coalesce(thought, ''), '?') OR contains(coalesce(result, ''), '?')), false)),
r_withhold AS (SELECT 'FM-2.4' AS mode_id, 'withhold' AS rule, c.trace_id, min(c.step_index) AS step_index, 0.6 AS confidence FROM calls c
               WHERE share_with IS NOT NULL
                 AND NOT EXISTS (SELECT 1 FROM steps m WHERE m.trace_id = c.trace_id AND m.step_index > c.step_index AND m.kind = 'message' AND m.from_agent = coalesce(c.agent, 'unknown'))
                 AND EXISTS (SELECT 1 FROM steps a WHERE a.trace_id = c.trace_id AND a.step_index > c.step_index AND a.kind IN ('tool_call', 'plan') AND a.agent = c.share_with)
               GROUP BY c.trace_id),
r_ignored AS (SELECT 'FM-2.5' AS mode_id, 'ignored' AS rule, m.trace_id, min(m.step_index) AS step_index, 0.65 AS confidence FROM steps m
              WHERE m.requires_ack AND NOT EXISTS (SELECT 1 FROM steps a WHERE a.trace_id = m.trace_id AND a.step_index > m.step_index AND a.kind <> 'message' AND a.agent = m.to_agent)
              GROUP BY m.trace_id),
r_role AS (SELECT 'FM-1.2' AS mode_id, 'role' AS rule, trace_id, min(step_index) AS step_index, 0.85 AS confidence FROM calls JOIN traces USING (trace_id)
           WHERE roles AND agent = 'agent-0' AND calls.tool = 'place_order' GROUP BY trace_id),
said AS (SELECT trace_id, step_index, kind, unnest(regexp_extract_all(concat_ws(' ', thought, result), '\\b[A-Z]{2,}[0-9]+\\b|#\\w+(-\\w+)*')) AS ent FROM steps),
known AS (SELECT trace_id, ent, min(step_index) AS since FROM (SELECT trace_id, step_index, unnest(regexp_extract_all(result, '\\b[A-Z]{2,}[0-9]+\\b|#\\w+(-\\w+)*')) AS ent FROM steps) GROUP BY ALL),
r_lost AS (SELECT 'FM-1.4' AS mode_id, 'lost_reference' AS rule, s.trace_id, min(s.step_index) AS step_index, 0.55 AS confidence
           FROM said s LEFT JOIN known n ON n.trace_id = s.trace_id AND n.ent = s.ent AND n.since < s.step_index
           WHERE s.step_index > 0 AND s.kind <> 'tool_call' AND n.ent IS NULL GROUP BY s.trace_id),
hits AS (SELECT * FROM r_repeat UNION ALL SELECT * FROM r_long UNION ALL SELECT * FROM r_reset UNION ALL SELECT * FROM r_early UNION ALL SELECT * FROM r_unverified UNION ALL SELECT * FROM r_weak
         UNION ALL SELECT * FROM r_mismatch UNION ALL SELECT * FROM r_derail UNION ALL SELECT * FROM r_forbidden UNION ALL SELECT * FROM r_clarify UNION ALL SELECT * FROM r_withhold
         UNION ALL SELECT * FROM r_ignored UNION ALL SELECT * FROM r_role UNION ALL SELECT * FROM r_lost),
detections AS (SELECT mode_id, rule, trace_id, CAST(step_index AS BIGINT) AS step_index, CAST(confidence AS DOUBLE) AS confidence FROM hits),
shares AS (SELECT * FROM (VALUES ('FM-1.1', 0.0), ('FM-1.2', 0.0), ('FM-1.3', 17.14), ('FM-1.4', 3.33), ('FM-1.5', 9.82), ('FM-2.1', 2.33), ('FM-2.2', 11.65), ('FM-2.3', 7.15), ('FM-2.4', 1.66),
             ('FM-2.5', 0.17), ('FM-2.6', 13.98), ('FM-3.1', 7.82), ('FM-3.2', 6.82), ('FM-3.3', 6.66)) s(mode_id, share)),
priors AS (SELECT mode_id, CAST(share + 1 AS DOUBLE) / sum(share + 1) OVER () AS prior FROM shares),
fused AS (SELECT trace_id, mode_id, count(*) * ln(any_value(prior) * 14) + sum(ln((confidence + 0.005) / (1 - confidence + 0.005))) AS score, max(confidence) AS confidence
          FROM detections JOIN priors USING (mode_id) WHERE confidence >= 0.5 GROUP BY trace_id, mode_id),
best AS (SELECT trace_id, mode_id FROM fused QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, mode_id) = 1),
verdicts AS (SELECT t.*, coalesce(b.mode_id, 'OTHER') AS primary_mode FROM traces t LEFT JOIN best b USING (trace_id))
"""
