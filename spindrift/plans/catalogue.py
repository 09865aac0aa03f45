"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import attribution, detect, fleet, prose, recall, repair, rollup, sequence, stats
from ..functions.calendar import micros
from ..sources import adapters, sinks
from ..streaming import live
from . import dsl
from .oracle import BASE, RULES

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
PRICES = adapters.PRICES
LIMITS = {"min_traces": 5, "failure_rate": 0.5, "avg_latency": 600, "p95_latency": 1500, "tokens": 1e6, "spend": 4.0, "breaches": 10}
NOW_US = 1_706_745_600_000_000  # 2024-02-01
MIDDLE_US = 1_705_449_600_000_000  # 2024-01-17


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return keep


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = adapters.steps(spark, d)
    return s, adapters.traces(s)


def verdict(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, t = both(spark, d)
    return attribution.verdicts(detect.run_rules(s, t), t), s


# sources and the expression language


@query("scan_steps", BASE + "SELECT trace_id, step_index, kind, tool, args_canon, fingerprint, tokens, latency_ms, error, agent, is_verify, mutating FROM steps")
def _(spark, d):
    return adapters.steps(spark, d).select("trace_id", "step_index", "kind", "tool", "args_canon", "fingerprint", "tokens", "latency_ms", "error", "agent", "is_verify", "mutating")


@query("scan_traces", BASE + "SELECT trace_id, store, task, model, success, created_us, n_steps, tokens, duration, breached FROM traces")
def _(spark, d):
    return both(spark, d)[1].select("trace_id", "store", "task", "model", "success", "created_us", "n_steps", "tokens", "duration", "breached")


def select(spark: SparkSession, d: str, expression: str) -> DataFrame:
    s, t = both(spark, d)
    return dsl.enriched(s, t).where(dsl.compile_expression(expression, now=NOW_US / 1e6)).select("trace_id")


FIELDS = """,
f AS (SELECT t.trace_id, t.task, t.model, t.success, t.created_us / 1e6 AS created, t.n_steps AS steps, t.tokens, t.duration,
        coalesce(max(CASE WHEN s.kind = 'tool_call' AND s.latency_ms > 0 THEN s.latency_ms END), 0) AS max_latency, count(s.error) AS errors,
        list(DISTINCT s.tool) FILTER (WHERE s.tool IS NOT NULL) AS tools, list(DISTINCT s.agent) FILTER (WHERE s.agent IS NOT NULL) AS agents,
        list(s.tool) FILTER (WHERE s.kind = 'tool_call' AND s.error IS NOT NULL) AS failed_tools
      FROM traces t JOIN steps s USING (trace_id) GROUP BY ALL)
"""
for _name, _expr, _where in [
    ("query_success_and_steps", "success == false and steps > 12", "success = false AND steps > 12"),
    ("query_unknown_outcome", "success == none or not (success != true)", "success IS NULL OR success IS NOT DISTINCT FROM true"),
    ("query_tools_contains", "tools contains ['get_item', 'call_api'] and not tools contains 'create_account'", "list_has_all(tools, ['get_item', 'call_api']) AND NOT list_contains(tools, 'create_account')"),
    ("query_tools_overlap", "tools in ['create_account', 'nothing'] or agents in ['agent-7']", "list_has_any(tools, ['create_account', 'nothing']) OR list_has_any(coalesce(agents, []), ['agent-7'])"),
    ("query_failed_tools", "failed_tools contains 'call_api' and errors >= 3", "coalesce(list_contains(failed_tools, 'call_api'), false) AND errors >= 3"),
    ("query_max_latency", "max_latency > 2000 or duration < 3000", "max_latency > 2000 OR duration < 3000"),
    ("query_created_window", "created >= 3w ago and created < 1w ago", "created >= 1706745600 - 3 * 604800 AND created < 1706745600 - 604800"),
    ("query_text", "task matches 'user 1[0-9]+$' and (model startswith 'm' and not model endswith '2')", "regexp_matches(task, 'user 1[0-9]+$') AND model LIKE 'm%' AND NOT model LIKE '%2'"),
    ("query_mixed_types", "task < 5 or tokens >= 'x' or tools == 'get_item' or steps == 7", "steps = 7"),
]:
    query(_name, BASE + FIELDS + f"SELECT trace_id FROM f WHERE {_where}")(lambda spark, d, e=_expr: select(spark, d, e))


@query("query_stats", BASE + "SELECT count(*) AS traces, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, avg(n_steps) AS mean_steps, avg(tokens) AS mean_tokens FROM traces WHERE n_steps > 5")
def _(spark, d):
    s, t = both(spark, d)
    rows = dsl.enriched(s, t).where(dsl.compile_expression("steps > 5", now=0.0))
    return rows.agg(F.count("*").alias("traces"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.avg("steps").alias("mean_steps"), F.avg("tokens").alias("mean_tokens"))


# rollups

_P95 = """,
ranked_{v} AS (SELECT subject, {v}, row_number() OVER (PARTITION BY subject ORDER BY {v}) - 1 AS rn, CAST(round_even(0.95 * (count(*) OVER (PARTITION BY subject) - 1), 0) AS BIGINT) AS at_ FROM sub WHERE {v} > 0),
p_{v} AS (SELECT subject, {v} AS p FROM ranked_{v} WHERE rn = at_)"""


def _card(subject: str) -> str:
    return BASE + f""", sub AS (SELECT *, {subject} AS subject FROM steps WHERE {subject} IS NOT NULL)""" + _P95.format(v="latency_ms") + _P95.format(v="tokens") + """,
card AS (SELECT s.subject, count(DISTINCT s.trace_id) AS traces, count(*) AS steps, count(*) FILTER (s.kind = 'tool_call') AS tool_calls, CAST(sum(s.tokens) AS BIGINT) AS tokens, count(s.error) AS errors,
  count(DISTINCT s.trace_id) FILTER (t.success = false) AS failed_traces, count(DISTINCT s.trace_id) FILTER (t.breached) AS breached_traces, CAST(sum(length(s.result)) AS BIGINT) AS result_chars,
  count(DISTINCT s.trace_id) FILTER (t.success = false) / count(DISTINCT s.trace_id) AS failure_rate, any_value(a.p) AS p95_ms, any_value(b.p) AS p95_tokens
FROM sub s JOIN traces t USING (trace_id) LEFT JOIN p_latency_ms a ON a.subject = s.subject LEFT JOIN p_tokens b ON b.subject = s.subject GROUP BY s.subject)
"""


@query("agent_scorecard", _card("coalesce(agent, 'unattributed')") + "SELECT * FROM card")
def _(spark, d):
    return rollup.scorecard(*both(spark, d), "agent")


@query("tool_scorecard", _card("tool") + "SELECT * FROM card")
def _(spark, d):
    return rollup.scorecard(*both(spark, d), "tool")


_LETTER = "CASE WHEN {0} <= 0.05 THEN 'A' WHEN {0} <= 0.15 THEN 'B' WHEN {0} <= 0.30 THEN 'C' WHEN {0} <= 0.50 THEN 'D' ELSE 'F' END"
_POINT = "CASE {0} WHEN 'A' THEN 4.0 WHEN 'B' THEN 3.0 WHEN 'C' THEN 2.0 WHEN 'D' THEN 1.0 ELSE 0.0 END"


@query("grades", _card("tool") + f""", g AS (SELECT *, {_LETTER.format('failure_rate')} AS reliability, CASE WHEN coalesce(nullif(tool_calls, 0), steps) > 0 THEN {_LETTER.format('errors / coalesce(nullif(tool_calls, 0), steps)')} END AS discipline,
  CASE WHEN breached_traces <= 0 THEN 'A' ELSE 'F' END AS budget FROM card),
h AS (SELECT *, 0.5 * {_POINT.format('reliability')} + 0.25 * {_POINT.format('budget')} + 0.25 * {_POINT.format('discipline')} AS m FROM g)
SELECT subject, traces, CASE WHEN traces < 2 THEN 'n/a' WHEN m >= 3.5 THEN 'A' WHEN m >= 3 THEN 'B' WHEN m >= 2.5 THEN 'C' WHEN m >= 2 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN traces >= 2 THEN reliability END AS reliability, CASE WHEN traces >= 2 THEN discipline END AS discipline, CASE WHEN traces >= 2 THEN budget END AS budget FROM h""")
def _(spark, d):
    return rollup.grades(rollup.scorecard(*both(spark, d), "tool"))


@query("failure_trend", BASE + """, b AS (SELECT *, (created_us - min(created_us) OVER ()) // 604800000000 AS bucket, min(created_us) OVER () AS since FROM traces)
SELECT bucket, strftime(make_timestamp(any_value(since) + bucket * 604800000000), '%Y-%m-%d') AS label, count(*) AS total, count(*) FILTER (success = false) AS failed, count(*) FILTER (success = false) / count(*) AS rate FROM b GROUP BY bucket""")
def _(spark, d):
    return rollup.trend(both(spark, d)[1])


@query("spend_by_model", BASE + """SELECT t.model, count(*) AS traces, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(any_value(rate) AS DOUBLE) AS rate, sum(tokens) / 1000 * CAST(any_value(rate) AS DOUBLE) AS est_cost,
CASE WHEN any_value(rate) IS NULL THEN CAST(sum(tokens) AS BIGINT) ELSE 0 END AS unpriced_tokens FROM traces t LEFT JOIN prices p ON p.model = t.model GROUP BY t.model""")
def _(spark, d):
    return rollup.spend_by_model(both(spark, d)[1], PRICES)


@query("ci_gates", BASE + """, v AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM traces) AS min_traces, (SELECT count(*) FILTER (success = false) / count(*) FROM traces) AS failure_rate, (SELECT avg(latency_ms) FROM steps) AS avg_latency,
  (SELECT CAST(latency_ms AS DOUBLE) FROM (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS rn, round_even(0.95 * (count(*) OVER () - 1), 0) AS at_ FROM steps) WHERE rn = at_) AS p95_latency,
  (SELECT CAST(sum(tokens) AS DOUBLE) FROM traces) AS tokens, (SELECT sum(tokens / 1000 * CAST(rate AS DOUBLE)) FROM traces JOIN prices USING (model)) AS spend, (SELECT CAST(count(*) FILTER (breached) AS DOUBLE) FROM traces) AS breaches),
w AS (SELECT unnest(['min_traces', 'failure_rate', 'avg_latency', 'p95_latency', 'tokens', 'spend', 'breaches']) AS gate, unnest([min_traces, failure_rate, avg_latency, p95_latency, tokens, spend, breaches]) AS value,
  unnest(CAST([5, 0.5, 600, 1500, 1e6, 4.0, 10] AS DOUBLE[])) AS threshold FROM v)
SELECT *, CASE WHEN gate = 'min_traces' THEN value >= threshold ELSE value <= threshold END AS ok FROM w""")
def _(spark, d):
    s, t = both(spark, d)
    return rollup.ci_gates(t, s, PRICES, LIMITS)


@query("week_compare", BASE + """, w AS (SELECT date_trunc('week', make_timestamp(created_us)) AS wk, count(*) AS traces, count(*) FILTER (success = false) AS failures, CAST(sum(tokens) AS BIGINT) AS tokens FROM traces GROUP BY 1)
SELECT strftime(a.wk, '%Y-%m-%d') AS week, a.traces, a.failures, a.tokens, b.traces AS prev_traces, b.failures AS prev_failures, (a.failures - b.failures) / nullif(b.failures, 0) AS delta FROM w a LEFT JOIN w b ON b.wk + INTERVAL 7 DAY = a.wk""")
def _(spark, d):
    return rollup.week_compare(both(spark, d)[1])


@query("retention_plan", BASE + f""", a AS (SELECT *, greatest(0, ({NOW_US} - created_us) / 86400000000.0) AS age FROM traces)
SELECT trace_id, CASE WHEN success IS NOT TRUE AND age < 20 THEN 'failure_young' WHEN success AND age < 10 THEN 'fresh' WHEN breached THEN 'protected_breached' WHEN annotated THEN 'protected_annotated'
  WHEN success IS NOT TRUE THEN 'failure past 20d' ELSE 'success past 10d' END AS fate FROM a""")
def _(spark, d):
    return rollup.retention_plan(both(spark, d)[1], NOW_US, 10, 20)


@query("multistore_dedupe", BASE + """, u AS (SELECT user_id AS trace_id, 'a' || CAST(n_steps % 3 AS VARCHAR) AS content, CAST(substr(store, 7) AS BIGINT) * 10000000 + created_us // 100000000 % 10000000 AS store_order FROM traces)
SELECT trace_id, arg_min(content, (store_order, content)) AS content, min(store_order) AS store_order, count(DISTINCT content) > 1 AS diverged FROM u GROUP BY trace_id""")
def _(spark, d):
    t = both(spark, d)[1]
    rows = t.select(F.col("user_id").alias("trace_id"), F.concat(F.lit("a"), (F.col("n_steps") % 3).cast("string")).alias("content"), (F.substring("store", 7, 9).cast("long") * 10_000_000 + F.expr("created_us div 100000000 % 10000000")).alias("store_order"))
    return rollup.multistore(rows)


# rules, one query each

_RULES = {
    "repeat": ("r_repeat", lambda s, t: detect.repeat(s)), "long_loop": ("r_long", lambda s, t: detect.long_loop(s, t)), "reset": ("r_reset", lambda s, t: detect.reset(s)),
    "premature": ("r_early", lambda s, t: detect.premature(t)), "missing_verify": ("r_unverified", lambda s, t: detect.missing_verify(s)), "weak_verify": ("r_weak", lambda s, t: detect.weak_verify(s)),
    "intent_mismatch": ("r_mismatch", lambda s, t: detect.intent_mismatch(s)), "derail": ("r_derail", lambda s, t: detect.derail(s)), "forbidden": ("r_forbidden", detect.forbidden),
    "clarify": ("r_clarify", lambda s, t: detect.clarify(s, t)), "withhold": ("r_withhold", lambda s, t: detect.withhold(s)), "ignored": ("r_ignored", lambda s, t: detect.ignored(s)),
    "role": ("r_role", detect.role), "lost_reference": ("r_lost", lambda s, t: detect.lost_reference(s)),
}
for _name, (_cte, _f) in _RULES.items():
    query(f"detect_{_name}", BASE + RULES + f"SELECT mode_id, rule, trace_id, CAST(step_index AS BIGINT) AS step_index, CAST(confidence AS DOUBLE) AS confidence FROM {_cte}")(lambda spark, d, f=_f: f(*both(spark, d)))


@query("detect_cycle")
def _(spark, d):
    return detect.cycle(adapters.steps(spark, d))


@query("run_rules", BASE + RULES + "SELECT mode_id, count(*) AS traces, min(confidence) AS least, max(confidence) AS most FROM detections GROUP BY mode_id")
def _(spark, d):
    return detect.run_rules(*both(spark, d)).groupBy("mode_id").agg(F.count("*").alias("traces"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


@query("attribute", BASE + RULES + "SELECT trace_id, success, primary_mode FROM verdicts")
def _(spark, d):
    return verdict(spark, d)[0].select("trace_id", "success", "primary_mode")


@query("fusion_scores", BASE + RULES + "SELECT trace_id, mode_id, round(score, 6) AS score, confidence FROM fused")
def _(spark, d):
    return attribution.fused(detect.run_rules(*both(spark, d))).select("trace_id", "mode_id", F.round("score", 6).alias("score"), "confidence")


@query("store_stats", BASE + RULES + "SELECT store, count(*) AS traces, count(*) FILTER (success = false) AS failures, count(*) FILTER (success = false AND primary_mode = 'OTHER') AS unattributed, avg(n_steps) AS avg_steps, count(*) FILTER (breached) AS breached, CAST(sum(tokens) AS BIGINT) AS tokens FROM verdicts GROUP BY store")
def _(spark, d):
    return rollup.store_stats(verdict(spark, d)[0])


@query("fleet_top_modes", BASE + RULES + "SELECT store, primary_mode AS mode_id, count(*) AS failures, row_number() OVER (PARTITION BY store ORDER BY count(*) DESC, primary_mode) AS rank FROM verdicts WHERE success = false AND primary_mode <> 'OTHER' GROUP BY store, primary_mode QUALIFY rank <= 3")
def _(spark, d):
    return rollup.top(rollup.mode_counts(verdict(spark, d)[0]), "store", "failures", "mode_id", 3).withColumn("rank", F.col("rank").cast("long"))


@query("clusters", BASE + RULES + """, tl AS (SELECT trace_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM steps WHERE kind = 'tool_call' GROUP BY trace_id)
SELECT primary_mode AS mode_id, coalesce(tools, '') AS tools, count(*) AS size, arg_min(task, (created_us, trace_id)) AS example FROM verdicts LEFT JOIN tl USING (trace_id) WHERE success = false AND primary_mode <> 'OTHER' GROUP BY 1, 2""")
def _(spark, d):
    return attribution.clusters(*verdict(spark, d))


@query("deployment_compare", BASE + RULES + f"""SELECT primary_mode AS mode_id, count(*) FILTER (created_us < {MIDDLE_US}) AS before, count(*) FILTER (created_us >= {MIDDLE_US}) AS after,
CASE WHEN count(*) FILTER (created_us < {MIDDLE_US}) = 0 THEN 'new' WHEN count(*) FILTER (created_us >= {MIDDLE_US}) = 0 THEN 'gone' ELSE 'both' END AS status FROM verdicts WHERE success = false AND primary_mode <> 'OTHER' GROUP BY 1""")
def _(spark, d):
    return rollup.compare(verdict(spark, d)[0], F.col("created_us") < MIDDLE_US)


@query("triage", BASE + RULES + """, ag AS (SELECT trace_id, count(DISTINCT agent) AS agents FROM steps GROUP BY trace_id),
f AS (SELECT v.*, agents FROM verdicts v JOIN ag USING (trace_id) WHERE success = false),
g AS (SELECT trace_id, CASE primary_mode WHEN 'OTHER' THEN 'unattributed' ELSE primary_mode END AS mode, annotated, 1.0::DOUBLE / row_number() OVER (PARTITION BY primary_mode ORDER BY created_us, trace_id) AS novelty,
  tokens / greatest(max(tokens) OVER (), 1) AS cost, agents / greatest(max(agents) OVER (), 1) AS blast, (created_us - min(created_us) OVER ()) / nullif(max(created_us) OVER () - min(created_us) OVER (), 0) AS recency FROM f)
SELECT *, 2 * novelty + cost + blast + 0.5::DOUBLE * recency AS score FROM g""")
def _(spark, d):
    return attribution.triage(*verdict(spark, d))


@query("counterfactual_unique", BASE + RULES + "SELECT trace_id, any_value(mode_id) AS root_mode FROM detections WHERE confidence >= 0.5 GROUP BY trace_id HAVING count(*) = 1")
def _(spark, d):
    """Traces whose one detection is the root cause: without its step nothing is found."""
    rows = detect.run_rules(*both(spark, d)).where("confidence >= 0.5")
    return rows.groupBy("trace_id").agg(F.count("*").alias("n"), F.first("mode_id").alias("root_mode")).where("n = 1").drop("n")


# robust statistics


def calls(spark: SparkSession, d: str) -> DataFrame:
    return adapters.steps(spark, d).where("kind = 'tool_call'")


def _outliers(keys: str, value: str, where: str, source: str = "steps") -> str:
    return BASE + f""", r AS (SELECT *, {value} AS x FROM {source} WHERE {where}),
m AS (SELECT {keys}, median(x) AS med, count(*) AS n FROM r GROUP BY ALL),
dv AS (SELECT r.*, med, n, abs(x - med) AS off FROM r JOIN m USING ({keys})),
s AS (SELECT {keys}, CASE WHEN median(off) > 0 THEN median(off) ELSE avg(off) END AS scale FROM dv GROUP BY ALL)
SELECT trace_id, step_index, tool, x AS value, med AS median, 0.6745::DOUBLE * (x - med) / scale AS robust_z FROM dv JOIN s USING ({keys}) WHERE n >= 5 AND scale > 0 AND abs(0.6745::DOUBLE * (x - med) / scale) > 3.5"""


for _name, _keys, _value, _where in [
    ("latency_anomalies_trace", ["trace_id"], "latency_ms", "latency_ms > 0"),
    ("latency_anomalies_fleet", ["tool"], "latency_ms", "latency_ms > 0"),
    ("token_anomalies_trace", ["trace_id"], "tokens", "tokens > 0"),
    ("token_anomalies_fleet", ["tool", "model"], "tokens", "tokens > 0"),
    ("result_anomalies", ["trace_id"], "length(result)", "result <> ''"),
]:
    query(_name, _outliers(", ".join(_keys), _value, f"kind = 'tool_call' AND {_where}"))(lambda spark, d, k=_keys, v=_value, w=_where: stats.outliers(calls(spark, d).where(w).withColumn("x", F.expr(v).cast("long")), k, "x"))

_FAMILY = """, r AS (SELECT *, latency_ms AS x FROM steps WHERE kind = 'tool_call' AND latency_ms > 0),
m0 AS (SELECT trace_id, median(x) AS med FROM r GROUP BY ALL HAVING count(*) >= 5), m1 AS (SELECT trace_id, tool, median(x) AS med FROM r GROUP BY ALL HAVING count(*) >= 5),
s0 AS (SELECT trace_id, any_value(med) AS med, CASE WHEN median(abs(x - med)) > 0 THEN median(abs(x - med)) ELSE avg(abs(x - med)) END AS scale FROM r JOIN m0 USING (trace_id) GROUP BY ALL),
s1 AS (SELECT trace_id, tool, any_value(med) AS med, CASE WHEN median(abs(x - med)) > 0 THEN median(abs(x - med)) ELSE avg(abs(x - med)) END AS scale FROM r JOIN m1 USING (trace_id, tool) GROUP BY ALL),
q AS (SELECT r.trace_id, step_index, r.tool, x, coalesce(s1.med, s0.med) AS med, coalesce(s1.scale, s0.scale) AS scale FROM r JOIN s0 ON s0.trace_id = r.trace_id LEFT JOIN s1 ON s1.trace_id = r.trace_id AND s1.tool = r.tool)
SELECT trace_id, step_index, tool, x AS value, med AS median, 0.6745::DOUBLE * (x - med) / scale AS robust_z FROM q WHERE scale > 0 AND abs(0.6745::DOUBLE * (x - med) / scale) > 3.5"""


@query("latency_anomalies_per_tool", BASE + _FAMILY)
def _(spark, d):
    return stats.family_outliers(calls(spark, d).where("latency_ms > 0"), "latency_ms")


@query("psi_drift", BASE + f""", c AS (SELECT tool || ' {{k}}' AS action, count(*) FILTER (ts_us < {MIDDLE_US}) AS a, count(*) FILTER (ts_us >= {MIDDLE_US}) AS b FROM steps WHERE kind = 'tool_call' AND error IS NULL GROUP BY 1),
e AS (SELECT action, (a + 1e-6::DOUBLE) / (sum(a) OVER () + 1e-6::DOUBLE) AS baseline_share, (b + 1e-6::DOUBLE) / (sum(b) OVER () + 1e-6::DOUBLE) AS current_share FROM c)
SELECT *, round((baseline_share - current_share) * ln(baseline_share / current_share), 9) AS term FROM e""")
def _(spark, d):
    rows = stats.psi(adapters.steps(spark, d), F.col("ts_us") < MIDDLE_US)
    return rows.withColumn("term", F.round("term", 9))


_DAYS = """, days AS (SELECT store, strftime(make_timestamp(created_us), '%Y-%m-%d') AS day, count(*) AS traces, count(*) FILTER (success = false) AS failures, sum(tokens / 1000 * coalesce(CAST(rate AS DOUBLE), 0)) AS est_spend
  FROM traces LEFT JOIN prices USING (model) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY day) AS i FROM days),
slopes AS (SELECT a.store, median((b.est_spend - a.est_spend) / (b.i - a.i)) AS slope FROM o a JOIN o b ON a.store = b.store AND a.i < b.i GROUP BY 1)"""


def days(spark: SparkSession, d: str) -> DataFrame:
    t = both(spark, d)[1]
    return stats.daily(t, rollup.rate_of(F.col("model"), PRICES))


@query("daily_rollup", BASE + _DAYS + "SELECT store, day, traces, failures, round(est_spend, 6) AS est_spend FROM days")
def _(spark, d):
    return days(spark, d).withColumn("est_spend", F.round("est_spend", 6))


@query("theil_sen", BASE + _DAYS + "SELECT store, round(slope, 5) AS slope FROM slopes")
def _(spark, d):
    return stats.theil_sen(days(spark, d), "store", "day", "est_spend").withColumn("slope", F.round("slope", 5))


@query("spend_forecast", BASE + _DAYS + """, l AS (SELECT store, arg_max(est_spend, day) AS latest, max(day) AS last_day FROM days GROUP BY 1)
SELECT store, CAST(k AS BIGINT) AS offset, strftime(CAST(last_day AS DATE) + CAST(k AS INTEGER), '%Y-%m-%d') AS day, round(greatest(0, latest + slope * k), 6) AS est_spend,
  CAST(CASE WHEN latest > 3 THEN 0 WHEN slope > 0 THEN ceil((3 - latest) / slope) END AS BIGINT) AS days_to_ceiling FROM l JOIN slopes USING (store), (SELECT unnest(range(1, 15)) AS k)""")
def _(spark, d):
    return stats.forecast(days(spark, d), 3.0).withColumn("est_spend", F.round("est_spend", 6))


@query("failure_budget", BASE + _DAYS + """, c AS (SELECT *, sum(failures) OVER (PARTITION BY store ORDER BY day) AS burned FROM days)
SELECT store, CAST(max(burned) AS BIGINT) AS burned, min(CASE WHEN burned > 40 THEN day END) AS exhausted, CAST(40 AS BIGINT) AS allowance FROM c GROUP BY store""")
def _(spark, d):
    return stats.failure_budget(days(spark, d), 40)


_GRAMS = """, c AS (SELECT trace_id, 'tool_call:' || tool || ' {k}' AS g, row_number() OVER w AS pos, lead('tool_call:' || tool || ' {k}', 1) OVER w AS g2, lead('tool_call:' || tool || ' {k}', 2) OVER w AS g3 FROM steps WHERE kind = 'tool_call' WINDOW w AS (PARTITION BY trace_id ORDER BY step_index)),
grams AS (SELECT trace_id, pos, 1::BIGINT AS n, g AS gram FROM c UNION ALL SELECT trace_id, pos, 2, g || '|' || g2 FROM c WHERE g2 IS NOT NULL UNION ALL SELECT trace_id, pos, 3, g || '|' || g2 || '|' || g3 FROM c WHERE g3 IS NOT NULL),
pm AS (SELECT n, gram, count(*) AS occurrences, count(*) FILTER (success = false) AS failures, (count(*) FILTER (success = false) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS p_fail FROM grams JOIN traces USING (trace_id) GROUP BY 1, 2)"""


@query("precursor_mine", BASE + _GRAMS + "SELECT * FROM pm")
def _(spark, d):
    return stats.precursors(*both(spark, d))


@query("precursor_score", BASE + _GRAMS + """, b AS (SELECT trace_id, n, occurrences, p_fail FROM grams JOIN pm USING (n, gram) QUALIFY row_number() OVER (PARTITION BY trace_id, n ORDER BY occurrences DESC, pos) = 1)
SELECT trace_id, round(1 / (1 + exp(-sum(least(occurrences, 20) * n * ln(p_fail / (1 - p_fail))) / sum(least(occurrences, 20) * n))), 9) AS probability FROM b GROUP BY trace_id""")
def _(spark, d):
    s, t = both(spark, d)
    return stats.precursor_score(s, stats.precursors(s, t)).withColumn("probability", F.round("probability", 9))


@query("wilson_prf", """WITH p AS (SELECT lang AS mode, n_chars < 2000 AS predicted, quality = 0 AS gold FROM documents JOIN labels USING (doc_id)),
c AS (SELECT mode, count(*) FILTER (predicted AND gold) AS tp, count(*) FILTER (predicted AND NOT gold) AS fp, count(*) FILTER (NOT predicted AND gold) AS fn FROM p GROUP BY mode),
e AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp + fp AS n FROM c)
SELECT mode, tp, fp, fn, coalesce(pr, 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  CASE WHEN n = 0 THEN 0 ELSE round(greatest(0, (pr + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(pr * (1 - pr) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 9) END AS low,
  CASE WHEN n = 0 THEN 0 ELSE round(least(1, (pr + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(pr * (1 - pr) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 9) END AS high FROM e""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    out = stats.prf(rows.select(F.col("lang").alias("mode"), (F.col("n_chars") < 2000).alias("predicted"), (F.col("quality") == 0).alias("gold")))
    return out.withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query("ece", """WITH p AS (SELECT (n_chars % 1000) / 1000 AS confidence, quality = 1 AS correct FROM documents JOIN labels USING (doc_id)),
b AS (SELECT CAST(least(9, floor(confidence * 10)) AS BIGINT) AS bin, * FROM p)
SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM p) * abs(avg(confidence) - avg(CAST(correct AS DOUBLE))), 9) AS gap FROM b GROUP BY bin""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return stats.ece(rows.select(((F.col("n_chars") % 1000) / 1000).alias("confidence"), (F.col("quality") == 1).alias("correct"))).withColumn("gap", F.round("gap", 9))


# recall and text


@query("recall_timeline", BASE + """, tl AS (SELECT trace_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM steps WHERE kind = 'tool_call' GROUP BY trace_id), l AS (SELECT * FROM traces ORDER BY created_us DESC, trace_id DESC LIMIT 50)
SELECT trace_id, strftime(make_timestamp(created_us), '%Y-%m-%d') AS day, task, CASE WHEN success IS NULL THEN 'unknown' WHEN success THEN 'ok' ELSE 'failed' END AS outcome, coalesce(tools, '') AS tools, duration FROM l LEFT JOIN tl USING (trace_id)""")
def _(spark, d):
    return recall.timeline(*both(spark, d), 50)


@query("recall_search", BASE + """, x AS (SELECT trace_id, step_index, 'thought' AS field, 0 AS o, thought AS t FROM steps UNION ALL SELECT trace_id, step_index, 'result', 1, result FROM steps UNION ALL SELECT trace_id, step_index, 'error', 2, error FROM steps
  UNION ALL SELECT trace_id, -1, 'task', -1, task FROM traces)
SELECT trace_id, step_index, field, substr(t, greatest(instr(lower(t), 'c-7') - 60, 1), 160) AS excerpt FROM x WHERE contains(lower(t), 'c-7') QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY step_index, o) <= 8""")
def _(spark, d):
    return recall.search(*both(spark, d), "C-7")


@query("recall_summary", BASE + """, c AS (SELECT trace_id, count(*) FILTER (kind = 'tool_call') AS calls FROM steps GROUP BY 1)
SELECT strftime(make_timestamp(created_us), '%Y-%m-%d') AS day, count(*) AS conversations, count(*) FILTER (success = false) AS failed, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(calls) AS BIGINT) AS tool_calls FROM traces JOIN c USING (trace_id) GROUP BY 1""")
def _(spark, d):
    return recall.day_summary(*both(spark, d))


@query("recall_related", BASE + """, tl AS (SELECT t.trace_id, strftime(make_timestamp(any_value(created_us)), '%Y-%m-%d') AS day, coalesce(list(DISTINCT s.tool) FILTER (s.kind = 'tool_call'), []) AS tools FROM traces t JOIN steps s USING (trace_id) GROUP BY 1),
g AS (SELECT * FROM tl WHERE trace_id = (SELECT min(trace_id) FROM traces)),
r AS (SELECT a.trace_id, len(list_intersect(a.tools, g.tools)) / nullif(len(list_distinct(list_concat(a.tools, g.tools))), 0) AS j, a.day = g.day AS same FROM tl a, g WHERE a.trace_id <> g.trace_id)
SELECT trace_id, coalesce(j, 0) + CASE WHEN same THEN 0.5::DOUBLE ELSE 0 END AS score FROM r WHERE coalesce(j, 0) + CASE WHEN same THEN 0.5 ELSE 0 END > 0""")
def _(spark, d):
    s, t = both(spark, d)
    return recall.related(s, t, t.agg(F.min("trace_id")).first()[0])


@query("topics", """WITH w AS (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z][-._0-9a-z]{2,}')) AS word FROM conversations),
c AS (SELECT role, word, count(*) AS n FROM w WHERE length(word) <= 32 AND word NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'you', 'are', 'was') GROUP BY 1, 2)
SELECT role, word, n, row_number() OVER (PARTITION BY role ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 6""")
def _(spark, d):
    return recall.topics(spark.read.parquet(f"{d}/conversations.parquet"), "role", "text")


def _redact_sql() -> str:
    out, counts = "text", []
    for name, p in recall.REDACTIONS:
        counts.append(f"CAST(len(regexp_extract_all({out}, '{p}')) AS BIGINT) AS n_{name.lower()}")
        out = f"regexp_replace({out}, '{p}', '[{name}]', 'g')"
    return f"SELECT doc_id, {', '.join(counts)}, {out} AS redacted FROM documents"


@query("redact", _redact_sql())
def _(spark, d):
    return recall.redact(spark.read.parquet(f"{d}/documents.parquet"))


@query("toolscan", "SELECT page_id, unnest(list_filter([CASE WHEN regexp_matches(html, '(?i)<script') THEN 'script' END, CASE WHEN contains(html, '<!--') THEN 'comment' END, CASE WHEN regexp_matches(html, '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}]') THEN 'invisible' END, CASE WHEN regexp_matches(html, '(?i)ignore (all )?(previous|prior) instructions') THEN 'orders' END], lambda x: x IS NOT NULL)) AS finding FROM pages")
def _(spark, d):
    return recall.tool_scan(spark.read.parquet(f"{d}/pages.parquet"))


@query("composition", BASE + """, p AS (SELECT store, kind, CAST(sum(greatest(1, length(result) // 4) + CASE WHEN thought IS NULL THEN 0 ELSE greatest(1, length(thought) // 4) END + greatest(1, length(args_canon) // 4)) AS BIGINT) AS tokens FROM steps GROUP BY 1, 2)
SELECT *, tokens / sum(tokens) OVER (PARTITION BY store) AS share FROM p""")
def _(spark, d):
    return recall.composition(adapters.steps(spark, d))


@query("budget_sim", BASE + """, c AS (SELECT *, sum(tokens) OVER (PARTITION BY trace_id ORDER BY step_index) AS sofar, sum(tokens) OVER (PARTITION BY trace_id) AS total FROM steps)
SELECT trace_id, step_index AS tripped_at, CAST(total - sofar AS BIGINT) AS saved FROM c WHERE kind = 'tool_call' AND sofar > 400 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY step_index) = 1""")
def _(spark, d):
    return recall.budget_trip(adapters.steps(spark, d), 400)


# order within a run


@query("risk_curve", BASE + """, m AS (SELECT *, CASE WHEN kind = 'tool_call' AND mutating THEN 1 WHEN is_verify THEN -1 ELSE 0 END AS mv, list(fingerprint) OVER (PARTITION BY trace_id ORDER BY step_index ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent FROM steps),
c AS (SELECT *, sum(mv) OVER w AS run FROM m WINDOW w AS (PARTITION BY trace_id ORDER BY step_index)), o AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY trace_id ORDER BY step_index)) AS open FROM c),
r AS (SELECT trace_id, step_index, least(1, (len(list_filter(recent, lambda x: x = fingerprint)) - 1) / 2) AS repetition, least(1, open / 2) AS debt FROM o)
SELECT trace_id, step_index, CAST(repetition AS DOUBLE) AS repetition, CAST(debt AS DOUBLE) AS debt, 0.3::DOUBLE * repetition + 0.2::DOUBLE * debt AS risk FROM r""")
def _(spark, d):
    return sequence.risk(adapters.steps(spark, d))


@query("integrity_chain", BASE + """, l AS (SELECT trace_id, any_value(task) AS task, list(concat(length(kind), ':', kind, coalesce(length(tool) || ':' || tool, '-'), length(args_canon), ':', args_canon, coalesce(length(result) || ':' || result, '-'), coalesce(length(thought) || ':' || thought, '-'), length(CAST(tokens AS VARCHAR)), ':', tokens, length(CAST(latency_ms AS VARCHAR)), ':', latency_ms, coalesce(length(error) || ':' || error, '-'), coalesce(length(agent) || ':' || agent, '-')) ORDER BY step_index) AS own FROM steps GROUP BY trace_id)
SELECT trace_id, list_reduce(list_prepend(sha256(task), own), lambda a, x: sha256(a || x)) AS final, CAST(len(own) AS BIGINT) AS steps FROM l""")
def _(spark, d):
    return sequence.chain(adapters.steps(spark, d), F.col("task")).select("trace_id", F.element_at("hashes", -1).alias("final"), F.size("hashes").cast("long").alias("steps"))


@query("align_topk")
def _(spark, d):
    s = adapters.steps(spark, d)
    return sequence.most_similar(s, s.agg(F.min("trace_id")).first()[0], 10)


@query("diff")
def _(spark, d):
    s, t = both(spark, d)
    before = F.lag("trace_id").over(Window.partitionBy("user_id").orderBy("created_us", "trace_id"))
    return sequence.diff(s, t.select(before.alias("a"), F.col("trace_id").alias("b")).where("a is not null"))


@query("context_forecast", BASE + """, r AS (SELECT s.trace_id, step_index, greatest(1, length(result) // 4) AS t FROM steps s WHERE kind = 'tool_call'),
c AS (SELECT *, sum(t) OVER (PARTITION BY trace_id ORDER BY step_index DESC) AS behind, count(*) OVER (PARTITION BY trace_id) AS n FROM r),
b AS (SELECT trace_id, task, greatest(1, length(task) // 4) AS head, unnest([10, 20, 40]) AS budget FROM traces),
k AS (SELECT b.trace_id, budget, any_value(head) AS head, coalesce(any_value(n), 0) AS n, count(*) FILTER (behind + head <= budget) AS kept, coalesce(sum(t) FILTER (behind + head <= budget), 0) AS used FROM b LEFT JOIN c USING (trace_id) GROUP BY 1, 2)
SELECT trace_id, CAST(budget AS BIGINT) AS budget, CAST(used + head AS BIGINT) AS used, CAST(n - kept AS BIGINT) AS evicted, CAST(kept AS BIGINT) AS kept, CASE WHEN n = 0 THEN 1 ELSE kept / n END AS recall FROM k""")
def _(spark, d):
    return sequence.context_forecast(adapters.steps(spark, d), [10, 20, 40])


# exports


@query("export_spans", BASE + """SELECT trace_id, substr(sha256(trace_id || '#' || CAST(step_index AS VARCHAR)), 1, 16) AS span_id, substr(sha256(trace_id), 1, 16) AS parent, coalesce(tool, kind) AS name,
CAST(min(ts_us) OVER (PARTITION BY trace_id) + 1000 * coalesce(sum(latency_ms) OVER w, 0) AS BIGINT) AS start_us, CAST(min(ts_us) OVER (PARTITION BY trace_id) + 1000 * coalesce(sum(latency_ms) OVER w, 0) + 1000 * latency_ms AS BIGINT) AS end_us,
CASE WHEN error IS NOT NULL THEN 2 ELSE 1 END AS status FROM steps WINDOW w AS (PARTITION BY trace_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    return sinks.spans(adapters.steps(spark, d))


@query("export_csv", BASE + """SELECT s.trace_id, s.task, s.model, CASE WHEN success IS NULL THEN '' WHEN success THEN 'True' ELSE 'False' END AS success, created_us / 1e6 AS created_at, step_index AS step, kind, coalesce(tool, '') AS tool, coalesce(agent, '') AS agent,
s.tokens, latency_ms, coalesce(error, '') AS error, breached AS budget_breached, result FROM steps s JOIN traces t USING (trace_id)""")
def _(spark, d):
    return sinks.csv_rows(*both(spark, d))


@query("prometheus", BASE + RULES + """, s AS (SELECT store, count(*) AS traces, count(*) FILTER (success = false) AS failures, count(*) FILTER (breached) AS breached, CAST(sum(tokens) AS BIGINT) AS tokens FROM verdicts GROUP BY store)
SELECT 'agent_' || n || '{store="' || store || '"} ' || CAST(v AS VARCHAR) AS line FROM (SELECT store, unnest(['traces', 'failures', 'breached', 'tokens']) AS n, unnest([traces, failures, breached, tokens]) AS v FROM s)""")
def _(spark, d):
    return sinks.prometheus(rollup.store_stats(verdict(spark, d)[0]))


# prose

_TURNS = """WITH c0 AS (SELECT CAST(conv_id AS VARCHAR) AS trace_id, turn, role, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 8000) AS text FROM conversations),
c1 AS (SELECT *, coalesce(first_value(CASE WHEN role = 'user' AND text <> '' THEN substr(text, 1, 200) END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS task,
  coalesce(bool_or(role <> 'assistant' AND regexp_matches(text, '{nudge}')) OVER (PARTITION BY trace_id), false) AS nudged FROM c0),
t AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY turn) - 1 AS pos, text, task, nudged, count(*) OVER (PARTITION BY trace_id) AS n FROM c1 WHERE role = 'assistant' AND text <> '')
""".format(nudge=prose.NUDGE)
_HIT = "SELECT '{0}' AS mode_id, '{1}' AS rule, trace_id, CAST({2} AS BIGINT) AS step_index, CAST({3} AS DOUBLE) AS confidence "
_lacking = " OR ".join(f"contains(lower(text), '{w}')" for w in prose.LACKING)
for _name, _sql_text in {
    "prose_no_verify": _HIT.format("FM-3.2", "prose_no_verify", "any_value(n) - 1", 0.5) + f"FROM t GROUP BY trace_id HAVING any_value(n) >= 4 AND NOT bool_or(regexp_matches(text, '{prose.VERIFY}'))",
    "prose_derail": _HIT.format("FM-2.3", "prose_derail", "any_value(n) - 3", 0.55) + "FROM (SELECT *, len(list_filter(regexp_extract_all(lower(task), '[a-z'']{4,}'), lambda w: contains(lower(text), w))) > 0 AS hit FROM t) GROUP BY trace_id HAVING any_value(n) >= 5 AND bool_or(hit AND pos < n // 2) AND NOT bool_or(hit AND pos >= n - 3)",
    "prose_ambiguity": _HIT.format("FM-2.2", "prose_ambiguity", "at_", 0.6) + f"FROM (SELECT trace_id, max(CASE WHEN {_lacking} THEN pos END) AS at_, max(CASE WHEN rtrim(text) LIKE '%?' THEN pos END) AS asked, bool_or(nudged) AS nudged FROM t GROUP BY trace_id) WHERE at_ IS NOT NULL AND nudged AND coalesce(asked, -1) < at_",
    "prose_outcome": _HIT.format("FM-3.2", "prose_outcome", "any_value(n) - 1", 0.7) + f"FROM t GROUP BY trace_id HAVING any_value(n) >= 2 AND NOT bool_or(regexp_matches(text, '{prose.RESULT}')) AND regexp_matches(arg_max(text, pos), '{prose.CLAIM}')",
}.items():
    _rule = getattr(prose, _name.removeprefix("prose_"))
    query(_name, _TURNS + _sql_text)(lambda spark, d, f=_rule: f(prose.turns(spark.read.parquet(f"{d}/conversations.parquet"))))


@query("prose_likeness")
def _(spark, d):
    return prose.likeness_rules(prose.turns(spark.read.parquet(f"{d}/conversations.parquet")))


# what would help


@query("repair")
def _(spark, d):
    return repair.plan_repair(*both(spark, d))


@query("conformal_sets")
def _(spark, d):
    scores = attribution.fused(detect.run_rules(*both(spark, d)))
    gold = scores.groupBy("trace_id").agg(F.min("mode_id").alias("mode_id"))
    p = repair.softmax(scores, 1.5)
    return repair.conformal_sets(p, repair.conformal_threshold(p, gold))


@query("dedupe")
def _(spark, d):
    return repair.duplicate_groups(adapters.steps(spark, d))


@query("merge_stores", BASE + """, a AS (SELECT user_id AS trace_id, max(n_steps) % 3 AS content FROM traces WHERE store <> 'store-0' GROUP BY 1), b AS (SELECT user_id AS trace_id, min(n_steps) % 3 AS content FROM traces WHERE store <> 'store-1' GROUP BY 1)
SELECT coalesce(a.trace_id, b.trace_id) AS trace_id, CASE WHEN b.content IS NULL THEN 'new' WHEN a.content IS NULL THEN 'kept' WHEN a.content = b.content THEN 'same' ELSE 'conflict' END AS status FROM a FULL OUTER JOIN b ON a.trace_id = b.trace_id""")
def _(spark, d):
    t = both(spark, d)[1]
    side = lambda store, pick: t.where(F.col("store") != store).groupBy(F.col("user_id").alias("trace_id")).agg((pick("n_steps") % 3).alias("content"))
    return repair.merge(side("store-0", F.max), side("store-1", F.min))


@query("grade_trend")
def _(spark, d):
    return repair.grade_trend(*both(spark, d), "agent", NOW_US - 3 * 86_400_000_000)


# fleets

_SURVEY = """, fc AS (SELECT * FROM steps WHERE kind = 'tool_call' AND latency_ms > 0), fm AS (SELECT store, tool, median(latency_ms) AS med, count(*) AS n FROM fc GROUP BY 1, 2),
fd AS (SELECT fc.*, med, n, abs(latency_ms - med) AS off FROM fc JOIN fm USING (store, tool)), fs AS (SELECT store, tool, CASE WHEN median(off) > 0 THEN median(off) ELSE avg(off) END AS scale FROM fd GROUP BY 1, 2),
an AS (SELECT store, count(*) AS anomalies FROM fd JOIN fs USING (store, tool) WHERE n >= 5 AND scale > 0 AND abs(0.6745::DOUBLE * (latency_ms - med) / scale) > 3.5 GROUP BY store),
tm AS (SELECT store, primary_mode AS top_mode FROM verdicts WHERE success = false AND primary_mode <> 'OTHER' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY store ORDER BY count(*) DESC, primary_mode) = 1),
survey AS (SELECT store, count(*) AS traces, count(*) FILTER (success = false) AS failures, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens / 1000 * coalesce(CAST(rate AS DOUBLE), 0)), 6) AS est_spend, count(*) FILTER (breached) AS breaches,
  coalesce(any_value(anomalies), 0) AS anomalies, any_value(top_mode) AS top_mode, count(*) FILTER (success = false) / count(*) AS failure_rate FROM verdicts LEFT JOIN prices USING (model) LEFT JOIN an USING (store) LEFT JOIN tm USING (store) GROUP BY store)"""


def surveyed(spark: SparkSession, d: str) -> DataFrame:
    return fleet.survey(*verdict(spark, d), PRICES).withColumn("est_spend", F.round("est_spend", 6))


@query("fleet_survey", BASE + RULES + _SURVEY + "SELECT * FROM survey")
def _(spark, d):
    return surveyed(spark, d)


@query("fleet_alerts", BASE + RULES + _SURVEY + """SELECT store, concat_ws(', ', CASE WHEN failure_rate >= 0.26 THEN 'failure rate' END, CASE WHEN anomalies >= 100 THEN 'anomalies' END, CASE WHEN est_spend > 2 THEN 'spend' END) AS reasons,
failure_rate >= 0.26 OR anomalies >= 100 OR est_spend >= 2 AS alert FROM survey""")
def _(spark, d):
    return fleet.alerts(surveyed(spark, d), rate=0.26, anomalies=100, spend=2.0)


@query("status", BASE + "SELECT count(*) AS traces, count(*) FILTER (success = false) AS failures, count(*) FILTER (success = false AND annotated) AS annotated_failures, count(*) FILTER (breached) AS breached, arg_max(trace_id, (created_us, trace_id)) FILTER (success = false) AS last_failure FROM traces")
def _(spark, d):
    return fleet.status(both(spark, d)[1])


@query("gap_days", BASE + """, o AS (SELECT DISTINCT store, CAST(make_timestamp(created_us) AS DATE) AS day FROM traces), s AS (SELECT store, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM o GROUP BY store)
SELECT store, strftime(day, '%Y-%m-%d') AS day FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.store = s.store AND o.day = CAST(s.day AS DATE))""")
def _(spark, d):
    return fleet.gap_days(both(spark, d)[1])


@query("recurring_modes", BASE + RULES + "SELECT mode_id, count(DISTINCT CAST(make_timestamp(created_us) AS DATE)) AS days FROM detections JOIN traces USING (trace_id) WHERE success = false GROUP BY mode_id HAVING days >= 2")
def _(spark, d):
    s, t = both(spark, d)
    return fleet.recurring_modes(t, detect.run_rules(s, t))


@query("worklist", _sql["triage"].replace("SELECT *, 2 * novelty", ", q AS (SELECT *, 2 * novelty", 1) + ") SELECT *, greatest(0, (SELECT count(*) FROM q WHERE NOT annotated) - 20) AS beyond FROM q WHERE NOT annotated ORDER BY score DESC, trace_id LIMIT 20")
def _(spark, d):
    return fleet.worklist(attribution.triage(*verdict(spark, d)), 20)


@query("jaccard_turns", _TURNS + """, g AS (SELECT trace_id, pos, list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substr(lower(text), i, 3))) AS s FROM t),
p AS (SELECT *, lag(s) OVER (PARTITION BY trace_id ORDER BY pos) AS l FROM g)
SELECT trace_id, pos, len(list_intersect(s, l)) / len(list_distinct(list_concat(s, l))) AS jaccard FROM p WHERE l IS NOT NULL""")
def _(spark, d):
    return fleet.turn_likeness(prose.turns(spark.read.parquet(f"{d}/conversations.parquet")))


@query("inbox_census", "SELECT event_type AS kind, count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS verified, CAST(max(epoch_us(ts)) AS DOUBLE) AS last FROM events GROUP BY 1")
def _(spark, d):
    posts = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("kind"), (F.col("event_id") % 3 != 0).alias("verified"), micros(F.col("ts")).cast("double").alias("received_at"))
    return live.census(posts)


from . import operations  # noqa: E402, F401  registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures ranked by how much a look at them is worth."""
    return _queries["triage"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
