"""Several stores at once: surveys, alerts, status, gaps in daily records, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import date_of
from . import rollup, stats


def survey(verdict: DataFrame, steps: DataFrame, prices: dict[str, float]) -> DataFrame:
    """store, traces, failures, failure_rate, tokens, est_spend, breaches, anomalies (of latency, by tool within the store),
    top_mode."""
    failed = F.coalesce(~F.col("success"), F.lit(False))
    base = verdict.groupBy("store").agg(F.count("*").alias("traces"), F.count_if(failed).alias("failures"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") / 1000 * F.coalesce(rollup.rate_of(F.col("model"), prices), F.lit(0.0))).alias("est_spend"), F.count_if("breached").alias("breaches"))
    calls = steps.where("kind = 'tool_call' and latency_ms > 0")
    odd = stats.scales(calls, ["store", "tool"], "latency_ms").where((F.col("n") >= stats.SAMPLES) & (F.col("scale") > 0))
    hits = calls.join(odd, ["store", "tool"]).where(F.abs(stats.robust_z("latency_ms")) > stats.CUT).groupBy("store").agg(F.count("*").alias("anomalies"))
    top = rollup.mode_counts(verdict).groupBy("store").agg(F.min_by("mode_id", F.struct(-F.col("failures"), "mode_id")).alias("top_mode"))
    return base.join(hits, "store", "left").join(top, "store", "left").withColumns({"anomalies": F.coalesce("anomalies", F.lit(0)), "failure_rate": F.col("failures") / F.col("traces")})


def alerts(surveyed: DataFrame, rate: float | None = None, anomalies: int | None = None, spend: float | None = None, breaches: int | None = None) -> DataFrame:
    """store, reasons, alert. A limit of none isn't looked at. Spend is a reason only above its limit, but alerts at it as well."""
    rules: list[tuple[str, Column, Column]] = []
    if rate is not None:
        rules.append(("failure rate", F.col("failure_rate") >= rate, F.col("failure_rate") >= rate))
    if anomalies is not None:
        rules.append(("anomalies", F.col("anomalies") >= anomalies, F.col("anomalies") >= anomalies))
    if spend is not None:
        rules.append(("spend", F.col("est_spend") > spend, F.col("est_spend") >= spend))
    if breaches is not None:
        rules.append(("breaches", F.col("breaches") >= breaches, F.col("breaches") >= breaches))
    fire = F.lit(False)
    for _, _, gate in rules:
        fire = fire | gate
    reasons = F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(r, name) for name, r, _ in rules))), ", ")
    return surveyed.select("store", reasons.alias("reasons"), fire.alias("alert"))


def status(verdict: DataFrame) -> DataFrame:
    """One row: traces, failures, annotated failures, agents' runs over budget, and the last failure."""
    failed = F.coalesce(~F.col("success"), F.lit(False))
    return verdict.agg(F.count("*").alias("traces"), F.count_if(failed).alias("failures"), F.count_if(failed & F.col("annotated")).alias("annotated_failures"), F.count_if("breached").alias("breached"), F.max_by(F.when(failed, F.col("trace_id")), F.when(failed, F.struct("created_us", "trace_id"))).alias("last_failure"))


def gap_days(traces: DataFrame) -> DataFrame:
    """store, day of days without a run between a store's first and last."""
    own = traces.select("store", date_of(F.col("created_us")).alias("day")).distinct()
    span = own.groupBy("store").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(own, ["store", "day"], "left_anti").select("store", F.col("day").cast("string").alias("day"))


def recurring_modes(verdict: DataFrame, detections: DataFrame) -> DataFrame:
    """mode_id, days of modes that fire in failures of two days or more."""
    rows = detections.join(verdict.where("success = false").select("trace_id", date_of(F.col("created_us")).alias("day")), "trace_id")
    return rows.groupBy("mode_id").agg(F.countDistinct("day").alias("days")).where("days >= 2")


def worklist(ranked: DataFrame, limit: int) -> DataFrame:
    """The failures nobody has annotated, by rank; beyond: how many are left out, counted before the cut."""
    rows = ranked.where("not annotated")
    left = rows.count()
    return rows.orderBy(F.desc("score"), "trace_id").limit(limit).withColumn("beyond", F.lit(max(0, left - limit)).cast("long"))


def turn_likeness(turns: DataFrame) -> DataFrame:
    """trace_id, pos, jaccard: each turn against the one before it, by letter triples."""
    three = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.lower(c), i, F.lit(3))))
    rows = turns.withColumn("last", F.lag("text").over(W.partitionBy("trace_id").orderBy("pos"))).where("last is not null")
    a, b = three(F.col("text")), three(F.col("last"))
    return rows.select("trace_id", "pos", (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("jaccard"))
