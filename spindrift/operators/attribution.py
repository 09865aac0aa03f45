"""From detections to verdicts: priors, fused evidence, the primary mode, clusters, and the rankings made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Published shares of the modes in per cent; those without one count as 0.
SHARES = {"FM-1.1": 0.0, "FM-1.2": 0.0, "FM-1.3": 17.14, "FM-1.4": 3.33, "FM-1.5": 9.82, "FM-2.1": 2.33, "FM-2.2": 11.65, "FM-2.3": 7.15, "FM-2.4": 1.66, "FM-2.5": 0.17, "FM-2.6": 13.98, "FM-3.1": 7.82, "FM-3.2": 6.82, "FM-3.3": 6.66}
NAMES = {"FM-1.1": "Disobey Task Specification", "FM-1.2": "Disobey Role Specification", "FM-1.3": "Step Repetition", "FM-1.4": "Loss of Conversation History", "FM-1.5": "Unaware of Termination Conditions", "FM-2.1": "Conversation Reset", "FM-2.2": "Fail to Ask for Clarification", "FM-2.3": "Task Derailment", "FM-2.4": "Information Withholding", "FM-2.5": "Ignored Other Agent's Input", "FM-2.6": "Reasoning-Action Mismatch", "FM-3.1": "Premature Termination", "FM-3.2": "No or Incomplete Verification", "FM-3.3": "Incorrect Verification"}
FLOOR, EPSILON = 0.5, 0.005


def modes(spark: SparkSession) -> DataFrame:
    """The dimension: mode_id, name, category, share, prior."""
    total = sum(s + 1 for s in SHARES.values())
    return spark.createDataFrame([(m, NAMES[m], "FC" + m[3], s, (s + 1) / total) for m, s in SHARES.items()], "mode_id string, name string, category string, share double, prior double")


def fused(detections: DataFrame) -> DataFrame:
    """trace_id, mode_id, score, confidence. The prior's log-odds count once for each detection."""
    llr = F.log((F.col("confidence") + EPSILON) / (1 - F.col("confidence") + EPSILON))
    rows = detections.where(F.col("confidence") >= FLOOR).join(F.broadcast(modes(detections.sparkSession).select("mode_id", "prior")), "mode_id")
    return rows.groupBy("trace_id", "mode_id").agg((F.sum(F.log(F.col("prior") * len(SHARES))) + F.sum(llr)).alias("score"), F.max("confidence").alias("confidence"))


def verdicts(detections: DataFrame, traces: DataFrame) -> DataFrame:
    """Each trace with its primary mode (OTHER without one)."""
    best = fused(detections).groupBy("trace_id").agg(F.min_by("mode_id", F.struct(-F.col("score"), "mode_id")).alias("mode"))
    return traces.join(best, "trace_id", "left").withColumn("primary_mode", F.coalesce("mode", F.lit("OTHER"))).drop("mode")


def clusters(verdict: DataFrame, steps: DataFrame) -> DataFrame:
    """Failed, attributed traces by mode and the tools they called: mode_id, tools, size, example (the first task)."""
    tools = steps.where("kind = 'tool_call'").groupBy("trace_id").agg(F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"))
    rows = verdict.where("success = false and primary_mode <> 'OTHER'").join(tools, "trace_id", "left")
    return rows.groupBy(F.col("primary_mode").alias("mode_id"), F.coalesce("tools", F.lit("")).alias("tools")).agg(F.count("*").alias("size"), F.min_by("task", F.struct("created_us", "trace_id")).alias("example"))


def triage(verdict: DataFrame, steps: DataFrame) -> DataFrame:
    """Failures ranked: novelty (1 over the number of its mode so far, twice), cost, blast radius (agents) and recency (half),
    each from 0 to 1. The extremes over all failures are four numbers; they come to the driver."""
    agents = steps.groupBy("trace_id").agg(F.countDistinct("agent").alias("agents"))
    rows = verdict.where("success = false").join(agents, "trace_id")
    tokens, most, since, until = rows.agg(F.max("tokens"), F.max("agents"), F.min("created_us"), F.max("created_us")).first()
    mode = F.when(F.col("primary_mode") == "OTHER", "unattributed").otherwise(F.col("primary_mode"))
    return rows.select(
        "trace_id",
        mode.alias("mode"),
        "annotated",
        (1 / F.row_number().over(W.partitionBy("primary_mode").orderBy("created_us", "trace_id"))).alias("novelty"),
        (F.col("tokens") / max(tokens or 0, 1)).alias("cost"),
        (F.col("agents") / max(most or 0, 1)).alias("blast"),
        ((F.col("created_us") - F.lit(since or 0)) / (((until or 0) - (since or 0)) or 1_000_000)).alias("recency"),
    ).withColumn("score", 2 * F.col("novelty") + F.col("cost") + F.col("blast") + 0.5 * F.col("recency"))
