"""Digests of fleets over time: snapshots by day, their compaction and trends, agents' days, and what a shift hands on.

A snapshot row is day, seq (its place in the day), store and counts; the last seq of a day stands for the day. Days are
few; what is windowed over them is bounded by time, not by runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stats
from ..functions.calendar import day_of

BLOCKS = "▁▂▃▄▅▆▇█"


def compact(rows: DataFrame) -> DataFrame:
    """Rows of each day's last snapshot, with the number of snapshots that the day had."""
    of = rows.groupBy("day").agg(F.max("seq").alias("last"), F.countDistinct("seq").alias("snapshots"))
    return rows.join(of, "day").where("seq = last").drop("last")


def rotated(rows: DataFrame, today: str, keep_days: int) -> DataFrame:
    """Rows of days that are at most so many days old."""
    return rows.where(F.date_diff(F.lit(today).cast("date"), F.col("day").cast("date")) <= keep_days)


def trend_days(rows: DataFrame) -> DataFrame:
    """day, snapshots, stores, traces, failures, tokens, failure_rate (weighted by runs; null without any)."""
    out = compact(rows).groupBy("day").agg(F.max("snapshots").alias("snapshots"), F.count("*").alias("stores"), *(F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).alias(c) for c in ("traces", "failures", "tokens")))
    return out.withColumn("failure_rate", F.when(F.col("traces") > 0, F.round(F.col("failures") / F.col("traces"), 4)))


def agent_days(agents: DataFrame, agent: str) -> DataFrame:
    """day, steps, errors, tokens of one agent, from the agents that each day's last snapshot lists."""
    return compact(agents).where(F.col("agent") == agent).groupBy("day").agg(*(F.sum(c).alias(c) for c in ("steps", "errors", "tokens")))


def trend_verdict(slope: Column, mean: Column) -> Column:
    """worsening, improving or flat: the slope against 0.05 of the mean, or of 1 where the mean is 0.5 or less."""
    scale = 0.05 * F.when(mean > 0.5, mean).otherwise(1.0)
    return F.when(slope.isNull(), "no data").when(slope > scale, "worsening").when(slope < -scale, "improving").otherwise("flat")


def trends(days: DataFrame, series: list[str]) -> DataFrame:
    """series, slope (Theil and Sen's, over the days in order), mean, verdict."""
    long = days.select("day", F.explode(F.array(*(F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("v")) for s in series))).alias("x")).select("day", "x.series", "x.v")
    mean = long.groupBy("series").agg(F.avg("v").alias("mean"))
    return mean.join(stats.theil_sen(long, "series", "day", "v"), "series", "left").select("series", "slope", "mean", trend_verdict(F.col("slope"), F.col("mean")).alias("verdict"))


def sparkline(days: DataFrame, key: str, value: str) -> DataFrame:
    """key, line: each day's value as one of eight blocks between the least and the most of its series; values that are all
    equal stand at half height."""
    w = W.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    at = F.when(high > low, F.floor((F.col(value) - low) / (high - low) * (len(BLOCKS) - 1))).otherwise(len(BLOCKS) // 2).cast("int")
    rows = days.withColumn("block", F.substring(F.lit(BLOCKS), at + 1, F.lit(1)))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "block"))), lambda x: x.getField("block")), "").alias("line"))


def shift(traces: DataFrame, now_us: int, hours: int = 8) -> DataFrame:
    """store, arrived, failed, owed (failed without a note), before, failed_before: the shift that ends now, and the one before
    it, worst first: by failure rate, then what is owed, then failures."""
    span = hours * 3_600_000_000
    now = (F.col("created_us") > now_us - span) & (F.col("created_us") <= now_us)
    past = (F.col("created_us") > now_us - 2 * span) & (F.col("created_us") <= now_us - span)
    bad = F.col("success") == False  # noqa: E712
    out = traces.groupBy("store").agg(F.count_if(now).alias("arrived"), F.count_if(now & bad).alias("failed"), F.count_if(now & bad & ~F.col("annotated")).alias("owed"), F.count_if(past).alias("before"), F.count_if(past & bad).alias("failed_before"))
    rate = F.when(F.col("arrived") > 0, F.col("failed") / F.col("arrived")).otherwise(0.0)
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc(rate), F.desc("owed"), F.desc("failed"), "store")).cast("long"))


def diary(traces: DataFrame) -> DataFrame:
    """day, n, line: a Markdown line for each run, in the order of its time, under its day."""
    mark = F.when(F.col("success").isNull(), "?").when(F.col("success"), "ok").otherwise("FAILED")
    line = F.concat(F.lit("- "), "trace_id", F.lit(": "), markdown(F.col("task")), F.lit(" ("), mark, F.lit(")"))
    day = day_of(F.col("created_us"))
    n = F.row_number().over(W.partitionBy(day).orderBy("created_us", "trace_id")).cast("long")
    return traces.select(day.alias("day"), n.alias("n"), line.alias("line"))


def recall_digest(steps: DataFrame, traces: DataFrame, width: int = 60) -> DataFrame:
    """day, trace_id, excerpt (of the first error), errors of failures: what a look back shows of each day."""
    first = steps.where("error is not null").groupBy("trace_id").agg(F.min_by("error", "step_index").alias("error"), F.count("*").alias("errors"))
    bad = traces.where("success = false").join(first, "trace_id", "left")
    return bad.select(day_of(F.col("created_us")).alias("day"), "trace_id", F.substring(F.trim(F.regexp_replace(F.coalesce("error", F.lit("")), r"\s+", " ")), 1, width).alias("excerpt"), F.coalesce("errors", F.lit(0)).alias("errors"))


def markdown(text: Column) -> Column:
    """Text that Markdown shows as it is."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " "), r"([\\`*_{}\[\]<>|#])", r"\\$1")


def mermaid(text: Column, width: int = 40) -> Column:
    """A label of a Mermaid chart: no quotes, brackets or line ends, at most so wide."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\"'\[\](){}<>|;\r\n]+", " ")), 1, width)
