"""The tables at hand as traces and steps.

A trace is one user's events in one week; its steps are the events in order. What events lack (plans, messages, roles,
claims to verify) follows from the number in `props`, so that every rule has cases to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import day_of, micros, week_of

#: USD for 1000 tokens; the third model has no price.
PRICES = {"m0": 0.01, "m1": 0.02}
STORES = 3


#: Parquet bytes of events whose steps one task handles, and the tables of so many such parts or fewer that Spark deals out itself.
PART_BYTES, FEW = 1 << 20, 8


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the shapes that nearly all rows have are read without a parser and a formatter; they give the same as those
    plain = F.regexp_like("props", F.lit(r'\A\{"k": (?:0|[1-9][0-9]{0,17})\}\z'))
    k = F.when(plain, F.expr("substring(props, 7, length(props) - 7)").cast("long")).otherwise(F.get_json_object("props", "$.k").cast("long"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    monday = week_of(F.col("ts").cast("date"))
    number = F.year(monday) * 10_000 + F.month(monday) * 100 + F.dayofmonth(monday)
    week = F.when(F.year(monday).between(1000, 9999), number.cast("string")).otherwise(F.regexp_replace(monday.cast("string"), "-", ""))
    return e.withColumn("trace_id", F.concat_ws("-", F.col("user_id").cast("string"), week))


def _dealt(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events by trace, in parts whose number grows with the table, so that what a task holds doesn't. Texts of steps are
    made after the exchange, which Spark's own choice by exchanged bytes doesn't know of."""
    size = int(str(spark.read.parquet(f"{sf_dir}/events.parquet")._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    parts = -(-size // PART_BYTES)
    return events.repartition(parts, "trace_id") if parts > FEW else events


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each step: trace_id, step_index, kind, tool, args_canon, result, thought, tokens, latency_ms, error, agent and
    what the rules read."""
    k, event = F.col("k"), F.col("event_type")
    kind = (
        F.when((event == "click") & (k % 9 == 0), "message")
        .when((event == "view") & (k % 10 == 1), "response")
        .when((event == "view") & (k % 10 == 2), "plan")
        .when((event == "error") & (k % 4 == 0), "error")
        .otherwise("tool_call")
    )
    agent = lambda n: F.concat(F.lit("agent-"), n.cast("string"))
    tools = {"view": "get_item", "click": "search_items", "purchase": "place_order", "signup": "create_account", "error": "call_api"}
    tool: Column = F.lit(None).cast("string")
    for e, name in tools.items():
        tool = F.when(event == e, name).otherwise(tool)
    mine, other = agent(F.col("event_id") % 3), agent((F.col("event_id") + 1) % 3)
    call = F.col("kind") == "tool_call"
    out = _dealt(_events(spark, sf_dir), spark, sf_dir).withColumns({"kind": kind, "mine": mine, "other": other})
    out = out.withColumn("step_index", F.row_number().over(W.partitionBy("trace_id").orderBy("ts", "event_id")) - 1)
    task = F.concat(F.lit("handle user "), F.col("user_id").cast("string"), F.when(F.col("user_id") % 7 == 0, " or ask whether either will do").otherwise(""))
    return out.select(
        "trace_id",
        F.concat(F.lit("store-"), (F.col("user_id") % STORES).cast("string")).alias("store"),
        F.col("step_index").cast("long").alias("step_index"),
        "user_id",
        "event_id",
        "ts",
        micros(F.col("ts")).alias("ts_us"),
        "k",
        "kind",
        F.when(F.col("kind") == "message", F.concat("mine", F.lit("->"), "other")).when(call, tool).alias("tool"),
        F.concat(F.lit('{"k": '), (k % 10).cast("string"), F.lit("}")).alias("args_canon"),
        F.concat(F.lit("item #c-"), (k % 10).cast("string")).alias("result"),
        F.when(F.col("kind") == "plan", F.when(k % 4 == 0, task).otherwise("plan the next move")).when(call & (k % 7 == 3), "now call search_items").when(F.col("kind") == "response", F.concat(F.lit("as noted in #c-"), ((k + 3) % 10).cast("string"))).alias("thought"),
        k.alias("tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
        F.when(event == "error", "boom").alias("error"),
        F.when(k % 17 != 0, F.col("mine")).alias("agent"),
        F.when(F.col("kind") == "message", F.col("mine")).alias("from_agent"),
        F.when(F.col("kind") == "message", F.col("other")).alias("to_agent"),
        ((F.col("kind") == "message") & (k % 2 == 1)).alias("requires_ack"),
        F.when(call & (k % 13 == 0), F.array(F.lit("agent-1"), F.lit("agent-9"))).alias("share_with"),
        (call & event.isin("purchase", "signup")).alias("mutating"),
        task.alias("task"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.concat_ws(":", "kind", F.coalesce(F.when(F.col("kind") == "message", F.concat("mine", F.lit("->"), "other")).when(call, tool), F.lit("None")), F.concat(F.lit('{"k": '), (k % 10).cast("string"), F.lit("}"))).alias("fingerprint"),
        F.coalesce(call & tool.contains("get_"), F.lit(False)).alias("is_verify"),
    )


def traces(steps_: DataFrame) -> DataFrame:
    """One row for each trace: trace_id, store, user_id, task, model, success, created_at (seconds), n_steps, tokens, duration,
    breached, annotated, step_limit, forbidden (tools), role_tools (role to tools), agent_roles (agent to role), ambiguous."""
    t = steps_.groupBy("trace_id").agg(
        F.first("store").alias("store"),
        F.first("user_id").alias("user_id"),
        F.first("task").alias("task"),
        F.first("model").alias("model"),
        F.min("ts_us").alias("created_us"),
        F.count("*").alias("n_steps"),
        F.sum("tokens").alias("tokens"),
        F.sum("latency_ms").alias("duration"),
        F.max_by("kind", "step_index").alias("last_kind"),
        F.max("step_index").alias("last_index"),
    )
    u = F.col("user_id")
    return t.withColumns({
        "success": F.when(u % 11 == 0, F.lit(None).cast("boolean")).otherwise(~((F.col("last_kind") == "error") | (u % 4 == 0))),
        "breached": u % 8 == 0,
        "annotated": u % 10 == 0,
        "step_limit": F.when(u % 3 == 0, F.lit(12)),
        "forbidden": F.when(u % 5 == 0, F.array(F.lit("create_account"), F.lit("drop_account"))),
        "role_tools": F.when(u % 6 == 0, F.create_map(F.lit("browser"), F.array(*map(F.lit, ("get_item", "search_items", "create_account", "call_api"))))),
        "agent_roles": F.when(u % 6 == 0, F.create_map(F.lit("agent-0"), F.lit("browser"))),
        "ambiguous": u % 35 == 3,
    })


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on runs, some on runs that are gone: trace_id, ts_us, author, verdict, note, event_id."""
    e = _events(spark, sf_dir).where("event_id % 11 = 0")
    n, third = F.col("event_id"), (F.col("event_id") % 3).cast("int")
    trace = F.when(n % 44 == 0, F.concat(F.lit("gone-"), F.col("user_id").cast("string"))).otherwise(F.col("trace_id"))
    return e.select(trace.alias("trace_id"), micros(F.col("ts")).alias("ts_us"), F.concat(F.lit("reviewer-"), third.cast("string")).alias("author"), F.element_at(F.array(*map(F.lit, ("Confirmed", "rejected", "OPEN"))), third + 1).alias("verdict"), F.concat(F.lit("looked at "), "event_type").alias("note"), "event_id")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of posts: row, received_us, verified, kind (null: malformed), sender, trace_id, payload."""
    e, n = _events(spark, sf_dir), F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "trace_ship").when(n % 97 != 0, F.col("event_type"))
    return e.select(n.alias("row"), micros(F.col("ts")).alias("received_us"), (n % 3 != 0).alias("verified"), kind.alias("kind"), F.concat(F.lit("host-"), (F.col("user_id") % 4).cast("string")).alias("sender"), "trace_id", F.concat(F.lit('{"Kind": "K-'), (F.col("k") % 10).cast("string"), F.lit('"}')).alias("payload"))


def snapshots(traces_: DataFrame) -> DataFrame:
    """Two snapshots a day: day, seq, store, traces, failures, tokens."""
    half = F.floor(F.col("created_us") / 43_200_000_000) % 2
    return traces_.groupBy(day_of(F.col("created_us")).alias("day"), half.alias("seq"), "store").agg(F.count("*").alias("traces"), F.count_if(F.col("success") == False).alias("failures"), F.sum("tokens").alias("tokens"))  # noqa: E712


def agent_snapshots(steps_: DataFrame, traces_: DataFrame, top: int = 2) -> DataFrame:
    """Of each snapshot and store the agents with most steps: day, seq, store, agent, steps, errors, tokens."""
    half = F.floor(F.col("created_us") / 43_200_000_000) % 2
    of = traces_.select("trace_id", day_of(F.col("created_us")).alias("day"), half.alias("seq"))
    rows = steps_.where("agent is not null").join(of, "trace_id").groupBy("day", "seq", "store", "agent").agg(F.count("*").alias("steps"), F.count("error").alias("errors"), F.sum("tokens").alias("tokens"))
    n = F.row_number().over(W.partitionBy("day", "seq", "store").orderBy(F.desc("steps"), "agent"))
    return rows.withColumn("n", n).where(F.col("n") <= top).drop("n")
