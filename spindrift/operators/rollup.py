"""Rollups: scorecards, store statistics, trends, spend, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import DAY_US, date_of, day_of, week_of


def p95(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, name: the nearest-rank 95th percentile of positive values, its rank rounded half to even."""
    n, rn = F.count("*").over(W.partitionBy(*keys)), F.row_number().over(W.partitionBy(*keys).orderBy(value))
    ranked = rows.where(F.col(value) > 0).select(*keys, value, (rn - 1).alias("rn"), F.bround(0.95 * (n - 1), 0).cast("long").alias("at"))
    return ranked.where("rn = at").select(*keys, F.col(value).alias(name))


def scorecard(steps: DataFrame, traces: DataFrame, by: str) -> DataFrame:
    """by: agent (null: unattributed) or tool (null: left out). One row each: traces, steps, calls, tokens, errors, failed and
    breached traces, failure rate, 95th percentiles of latency and tokens."""
    rows = steps.withColumn("subject", F.coalesce(by, F.lit("unattributed"))) if by == "agent" else steps.where("tool is not null").withColumn("subject", F.col("tool"))
    # one row for a trace and subject first: the distinct counts then need no further exchange of steps
    each = rows.groupBy("subject", "trace_id").agg(F.count("*").alias("steps"), F.count_if(F.col("kind") == "tool_call").alias("calls"), F.sum("tokens").alias("tokens"), F.count("error").alias("errors"), F.sum(F.length("result")).alias("chars"))
    both = each.join(traces.select("trace_id", F.coalesce(~F.col("success"), F.lit(False)).alias("failed"), "breached"), "trace_id")
    card = both.groupBy("subject").agg(F.count("*").alias("traces"), F.sum("steps").alias("steps"), F.sum("calls").alias("tool_calls"), F.sum("tokens").alias("tokens"), F.sum("errors").alias("errors"), F.count_if("failed").alias("failed_traces"), F.count_if("breached").alias("breached_traces"), F.sum("chars").alias("result_chars"))
    card = card.withColumn("failure_rate", F.col("failed_traces") / F.col("traces"))
    return card.join(p95(rows, ["subject"], "latency_ms", "p95_ms"), "subject", "left").join(p95(rows, ["subject"], "tokens", "p95_tokens"), "subject", "left")


def letter(rate: Column) -> Column:
    return F.when(rate <= 0.05, "A").when(rate <= 0.15, "B").when(rate <= 0.30, "C").when(rate <= 0.50, "D").otherwise("F")


def grades(card: DataFrame) -> DataFrame:
    """subject, traces, grade, reliability, discipline, budget; under two traces nothing is graded."""
    points = F.create_map(*(F.lit(x) for p in (("A", 4.0), ("B", 3.0), ("C", 2.0), ("D", 1.0), ("F", 0.0)) for x in p))
    calls = F.when(F.col("tool_calls") > 0, F.col("tool_calls")).otherwise(F.col("steps"))
    rows = card.withColumns({"reliability": letter(F.col("failure_rate")), "discipline": F.when(calls > 0, letter(F.col("errors") / calls)), "budget": F.when(F.col("breached_traces") <= 0, "A").otherwise("F")})
    graded = F.col("discipline").isNotNull()
    total = 0.5 * points[F.col("reliability")] + 0.25 * points[F.col("budget")] + F.when(graded, 0.25 * points[F.col("discipline")]).otherwise(0.0)
    mean = total / F.when(graded, 1.0).otherwise(0.75)
    grade = F.when(mean >= 3.5, "A").when(mean >= 3.0, "B").when(mean >= 2.5, "C").when(mean >= 2.0, "D").otherwise("F")
    enough = F.col("traces") >= 2
    return rows.select("subject", "traces", F.when(enough, grade).otherwise("n/a").alias("grade"), *(F.when(enough, F.col(c)).alias(c) for c in ("reliability", "discipline", "budget")))


def store_stats(verdict: DataFrame) -> DataFrame:
    """Traces, failures, unattributed failures and mean steps of each store."""
    failed = F.coalesce(~F.col("success"), F.lit(False))
    return verdict.groupBy("store").agg(F.count("*").alias("traces"), F.count_if(failed).alias("failures"), F.count_if(failed & (F.col("primary_mode") == "OTHER")).alias("unattributed"), F.avg("n_steps").alias("avg_steps"), F.count_if("breached").alias("breached"), F.sum("tokens").alias("tokens"))


def mode_counts(verdict: DataFrame) -> DataFrame:
    return verdict.where("success = false and primary_mode <> 'OTHER'").groupBy("store", F.col("primary_mode").alias("mode_id")).agg(F.count("*").alias("failures"))


def top(counts: DataFrame, group: str, by: str, then: str, n: int) -> DataFrame:
    """The n rows of each group with the most of `by`, ties by name."""
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(by), then))).where(F.col("rank") <= n)


def trend(traces: DataFrame, days: int = 7) -> DataFrame:
    """Failures in buckets of so many days, counted from the first trace."""
    since = traces.agg(F.min("created_us")).first()[0] or 0
    bucket = F.floor((F.col("created_us") - F.lit(since)) / (days * DAY_US)).cast("long")
    rows = traces.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("total"), F.count_if(F.col("success") == False).alias("failed"))  # noqa: E712
    return rows.select("bucket", day_of(F.lit(since) + F.col("bucket") * (days * DAY_US)).alias("label"), "total", "failed", (F.col("failed") / F.col("total")).alias("rate"))


def rate_of(model: Column, prices: dict[str, float]) -> Column:
    """A model's price for 1000 tokens, by its exact name; null without one. prices: the caller's table."""
    return F.create_map(*(F.lit(x) for p in prices.items() for x in p))[model]


def fuzzy_rate(model: Column, prices: dict[str, float]) -> Column:
    """By exact name, else in any case, else by what follows the last slash."""
    low = {k.lower(): v for k, v in prices.items()}
    last = {k.lower().rsplit("/", 1)[-1]: v for k, v in prices.items()}
    return F.coalesce(rate_of(model, prices), rate_of(F.lower(model), low), rate_of(F.element_at(F.split(F.lower(model), "/"), -1), last))


def spend_by_model(traces: DataFrame, prices: dict[str, float]) -> DataFrame:
    rows = traces.groupBy("model").agg(F.count("*").alias("traces"), F.sum("tokens").alias("tokens")).withColumn("rate", rate_of(F.col("model"), prices))
    return rows.select("model", "traces", "tokens", "rate", (F.col("tokens") / 1000 * F.col("rate")).alias("est_cost"), F.when(F.col("rate").isNull(), F.col("tokens")).otherwise(F.lit(0)).alias("unpriced_tokens"))


def ci_gates(traces: DataFrame, steps: DataFrame, prices: dict[str, float], limits: dict[str, float]) -> DataFrame:
    """gate, value, threshold, ok. One aggregate over traces and one over steps; the percentile keeps zeros and all kinds."""
    t = traces.agg(F.count("*").cast("double").alias("min_traces"), (F.count_if(F.col("success") == False) / F.count("*")).alias("failure_rate"), F.sum("tokens").cast("double").alias("tokens"), F.coalesce(F.sum(F.col("tokens") / 1000 * rate_of(F.col("model"), prices)), F.lit(0.0)).alias("spend"), F.count_if("breached").cast("double").alias("breaches"))  # noqa: E712
    s = steps.agg(F.avg("latency_ms").alias("avg_latency"))
    n = steps.count()
    at = int(round(0.95 * (n - 1))) if n else 0
    # by value first: the cumulative counts of distinct latencies find the rank without sorting all steps in one task
    by_value = steps.groupBy("latency_ms").agg(F.count("*").alias("n"))
    ranked = by_value.withColumn("upto", F.sum("n").over(W.orderBy("latency_ms").rowsBetween(W.unboundedPreceding, 0)))
    p = ranked.where(F.col("upto") > at).agg(F.min("latency_ms").cast("double").alias("p95_latency"))
    one = t.withColumn("j", F.lit(1)).join(s.withColumn("j", F.lit(1)), "j").join(p.withColumn("j", F.lit(1)), "j")
    names = ["min_traces", "failure_rate", "avg_latency", "p95_latency", "tokens", "spend", "breaches"]
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.lit(float(limits[g])).alias("threshold")) for g in names))).alias("x")).select("x.*")
    return rows.withColumn("ok", F.when(F.col("gate") == "min_traces", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")))


def compare(verdict: DataFrame, baseline: Column) -> DataFrame:
    """Modes of failures on either side of a condition: mode_id, before, after, status (new, gone, both)."""
    rows = verdict.where("success = false and primary_mode <> 'OTHER'").groupBy(F.col("primary_mode").alias("mode_id")).agg(F.count_if(baseline).alias("before"), F.count_if(~baseline).alias("after"))
    return rows.withColumn("status", F.when(F.col("before") == 0, "new").when(F.col("after") == 0, "gone").otherwise("both"))


def week_compare(traces: DataFrame) -> DataFrame:
    """ISO weeks with their traces and failures, and the same of the week before (null without one)."""
    rows = traces.groupBy(week_of(date_of(F.col("created_us"))).cast("string").alias("week")).agg(F.count("*").alias("traces"), F.count_if(F.col("success") == False).alias("failures"), F.sum("tokens").alias("tokens"))  # noqa: E712
    before = rows.select(F.date_add(F.col("week").cast("date"), 7).cast("string").alias("week"), F.col("traces").alias("prev_traces"), F.col("failures").alias("prev_failures"))
    return rows.join(before, "week", "left").withColumn("delta", (F.col("failures") - F.col("prev_failures")) / F.when(F.col("prev_failures") != 0, F.col("prev_failures")))


def retention_plan(traces: DataFrame, now_us: int, keep_days: int, failure_days: int) -> DataFrame:
    """trace_id, fate: kept for its age, protected, or retired and why."""
    age = F.greatest(F.lit(0.0), (F.lit(now_us) - F.col("created_us")) / DAY_US)
    bad = ~F.coalesce("success", F.lit(False))
    guard = F.when(F.col("breached"), "protected_breached").when(F.col("annotated"), "protected_annotated")
    fate = F.when(bad & (age < failure_days), "failure_young").when(~bad & (age < keep_days), "fresh").otherwise(F.coalesce(guard, F.when(bad, f"failure past {failure_days}d").otherwise(f"success past {keep_days}d")))
    return traces.select("trace_id", fate.alias("fate"))


def multistore(rows: DataFrame) -> DataFrame:
    """Several stores as one: of records with one id the first store's stays; diverged where their contents differ."""
    w = W.partitionBy("trace_id")
    return rows.withColumns({"rn": F.row_number().over(w.orderBy("store_order")), "diverged": F.min("content").over(w) != F.max("content").over(w)}).where("rn = 1").drop("rn")
