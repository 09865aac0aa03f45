"""Where runs go: native and chat JSON lines, spreadsheets, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def native_lines(records: DataFrame) -> DataFrame:
    """value: each record as a line that records.native reads back; arguments and meta as the objects they were."""
    steps = F.transform("steps", lambda s: F.struct(*(s.getField(k).alias(k) for k in ("kind", "tool", "result", "thought", "tokens", "latency_ms", "error", "agent")), F.parse_json(s.getField("args")).alias("args"), F.parse_json(s.getField("meta")).alias("meta")))
    return records.select(F.to_json(F.struct(F.col("trace_id").alias("id"), "task", "created_at", "model", "success", "final_output", F.parse_json("meta").alias("meta"), steps.alias("steps"))).alias("value"))


def chat_lines(records: DataFrame) -> DataFrame:
    """value: each record as a chat transcript. Calls keep their arguments; plans and responses are the assistant's."""

    def message(s, i):
        g = s.getField
        role = F.when(g("kind").isin("tool_call", "plan", "response", "error"), "assistant").when(g("kind") == "observation", "tool").otherwise("user")
        call = F.when(g("kind") == "tool_call", F.array(F.struct(F.concat(F.lit("call_"), i.cast("string")).alias("id"), F.lit("function").alias("type"), F.struct(g("tool").alias("name"), g("args").alias("arguments")).alias("function"))))
        return F.struct(role.alias("role"), F.when(g("kind") != "tool_call", F.coalesce(F.when(g("kind") == "plan", g("thought")), g("result"))).alias("content"), call.alias("tool_calls"), F.when(g("error").isNotNull(), True).alias("is_error"))

    first = F.array(F.struct(F.lit("user").alias("role"), F.col("task").alias("content"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"), F.lit(None).cast("boolean").alias("is_error")))
    return records.select(F.to_json(F.struct(F.concat(first, F.transform("steps", message)).alias("messages"), F.struct("task", "trace_id", "success").alias("metadata"))).alias("value"))


CELL = 240


def cell(text: Column) -> Column:
    """Text of a spreadsheet: what would be read as a formula is quoted, and what is long is cut with an ellipsis."""
    quoted = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A([=+\-@\t\r])", "'$1")
    return F.when(F.char_length(quoted) > CELL, F.concat(F.substring(quoted, 1, CELL - 1), F.lit("…"))).otherwise(quoted)


def csv_rows(steps: DataFrame, traces: DataFrame) -> DataFrame:
    """A row of fourteen columns for each step, with what its run says of it."""
    run = traces.select("trace_id", "success", (F.col("created_us") / 1e6).alias("created_at"), F.col("breached").alias("budget_breached"))
    outcome = F.when(F.col("success").isNull(), "").when(F.col("success"), "True").otherwise("False")
    return steps.join(run, "trace_id").select("trace_id", "task", F.coalesce("model", F.lit("")).alias("model"), outcome.alias("success"), "created_at", F.col("step_index").alias("step"), "kind", *(cell(F.col(c)).alias(c) for c in ("tool", "agent")), "tokens", "latency_ms", cell(F.col("error")).alias("error"), "budget_breached", cell(F.col("result")).alias("result"))


def prometheus(stats: DataFrame) -> DataFrame:
    """line: gauges of each store's statistics."""
    names = ["traces", "failures", "breached", "tokens"]
    rows = stats.select("store", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("v")) for n in names))).alias("x"))
    return rows.select(F.format_string('agent_%s{store="%s"} %s', F.col("x.name"), F.regexp_replace("store", r'(["\\])', r"\\$1"), F.col("x.v")).alias("line"))


def spans(steps: DataFrame) -> DataFrame:
    """trace_id, span_id, parent, name, start_us, end_us: steps as spans, each starting where those before it end."""
    w = W.partitionBy("trace_id").orderBy("step_index").rowsBetween(W.unboundedPreceding, -1)
    begin = F.min("ts_us").over(W.partitionBy("trace_id"))
    start = begin + 1000 * F.coalesce(F.sum("latency_ms").over(w), F.lit(0))
    root = F.substring(F.sha2("trace_id", 256), 1, 16)
    return steps.select("trace_id", F.substring(F.sha2(F.concat_ws("#", "trace_id", F.col("step_index").cast("string")), 256), 1, 16).alias("span_id"), root.alias("parent"), F.coalesce("tool", "kind").alias("name"), start.alias("start_us"), (start + 1000 * F.col("latency_ms")).alias("end_us"), F.when(F.col("error").isNotNull(), 2).otherwise(1).alias("status"))
