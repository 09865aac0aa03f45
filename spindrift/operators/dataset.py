"""Labelled runs: what labels a record bears, scores against them, floors, and rows to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)


def labels_of(json: Column) -> Column:
    """The labels of a record, sorted, each once: its list `labels`, else one of `label`, `failure_mode`, `mode`; null without."""
    many = F.from_json(F.get_json_object(json, "$.labels"), "array<string>")
    one = F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in ("label", "failure_mode", "mode")))
    return F.array_sort(F.array_distinct(F.coalesce(many, F.when(one.isNotNull(), F.array(one)))))


def evaluate_multi(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each sample's precision, recall, F1 (an empty prediction is right where nothing is to be found), and each mode's tp,
    fp, fn and the same over all samples. samples: trace_id, predicted, gold (arrays without repeats)."""
    both = F.size(F.array_intersect("predicted", "gold"))
    p = F.when(F.size("predicted") > 0, both / F.size("predicted")).otherwise(F.when(F.size("gold") == 0, 1.0).otherwise(0.0))
    r = F.when(F.size("gold") > 0, both / F.size("gold")).otherwise(1.0)
    each = samples.select("trace_id", p.alias("precision"), r.alias("recall")).withColumn("f1", SAFE(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    mode = samples.select(F.explode(F.array_union("predicted", "gold")).alias("mode"), "predicted", "gold")
    had, want = F.array_contains("predicted", F.col("mode")), F.array_contains("gold", F.col("mode"))
    per = mode.groupBy("mode").agg(F.count_if(had & want).alias("tp"), F.count_if(had & ~want).alias("fp"), F.count_if(~had & want).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return each, per.select("mode", "tp", "fp", "fn", SAFE(tp, tp + fp).alias("precision"), SAFE(tp, tp + fn).alias("recall"), SAFE(2 * tp, 2 * tp + fp + fn).alias("f1"))


def averages(each: DataFrame) -> DataFrame:
    return each.agg(F.count("*").alias("samples"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"sample_{c}") for c in ("precision", "recall", "f1")))


def floor_gate(per_mode: DataFrame, floors: DataFrame) -> DataFrame:
    """mode, metric, value, floor of each metric below its floor. A floor that is no finite number is broken itself; a mode
    without scores scores 0. floors: mode, metric, floor."""
    long = per_mode.select("mode", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")))).alias("x")).select("mode", "x.metric", "x.value")
    rows = floors.join(long, ["mode", "metric"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    bad = F.col("floor").isNull() | F.isnan("floor") | (F.abs("floor") == float("inf"))
    return rows.where(bad | (F.col("value") < F.col("floor"))).select("mode", "metric", "value", "floor")


def sft_rows(traces: DataFrame, detections: DataFrame, least: float = 0.7) -> DataFrame:
    """trace_id, prompt, completion for failed runs whose surest detection is sure enough: the run's outline, and its mode with
    the step."""
    best = detections.where(F.col("confidence") >= least).groupBy("trace_id").agg(F.min_by(F.struct("mode_id", "step_index"), F.struct(-F.col("confidence"), "mode_id", "step_index")).alias("x"))
    prompt = F.concat(F.lit("task: "), "task", F.lit("; steps: "), F.col("n_steps").cast("string"), F.lit("; last: "), "last_kind")
    rows = traces.where("success = false").join(best, "trace_id")
    return rows.select("trace_id", prompt.alias("prompt"), F.concat("x.mode_id", F.lit(" at step "), F.col("x.step_index").cast("string")).alias("completion"))
