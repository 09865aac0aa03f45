"""Recorded runs from JSON lines: native traces, chat transcripts, bare message lists and OTLP documents, as one table.

    trace_id, task, created_at, model, success, final_output, meta (JSON), steps (array of step structs)

What a record holds is coerced rather than trusted: counts that are no numbers, negative or endless are 0, and at most
ten million; outcomes are true, false or null; arguments that are no objects are empty. Lines that are no JSON objects,
or whose steps are no list, come back from rejected(), with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAP, MOST_STEPS, MOST_TEXT = 10_000_000, 10_000, 4000
STEP = "struct<kind:string,tool:string,args:string,result:string,thought:string,tokens:bigint,latency_ms:bigint,error:string,agent:string,meta:string>"
_RAW = "struct<kind:variant,tool:variant,args:variant,result:variant,thought:variant,tokens:variant,latency_ms:variant,error:variant,agent:variant,meta:variant>"
SAFE_ID = r"^[0-9A-Za-z][-.0-9A-Z_a-z]*$"


def _text(v: Column) -> Column:
    """Scalars as text; null stays null."""
    return F.try_variant_get(v, "$", "string")


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0).isin(*kinds), F.lit(False))


def count(v: Column) -> Column:
    """A number of 0 to CAP, cut to a whole; what isn't a number counts as 0, truth values too."""
    x = F.when(_is(v, "BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(v, "$", "double"))
    x = F.when(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf")), x).otherwise(0.0)
    return F.least(x, F.lit(float(CAP))).cast("bigint")


def epoch(v: Column) -> Column:
    x = F.when(_is(v, "BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(v, "$", "double"))
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(0.0)


def outcome(v: Column) -> Column:
    word = F.lower(F.trim(_text(v)))
    return F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean")).when(_is(v, "STRING"), F.when(word == "true", True).when(word == "false", False)).when(_is(v, "BIGINT", "DECIMAL", "DOUBLE"), F.when(word.isin("1", "1.0"), True).when(word.isin("0", "0.0"), False))


def obj(v: Column) -> Column:
    """An object as JSON text; anything else as an empty one."""
    return F.when(_is(v, "OBJECT"), F.to_json(v)).otherwise("{}")


def _step(s: Column) -> Column:
    g = s.getField
    word = lambda name: _text(g(name))
    return F.struct(F.coalesce(word("kind"), F.lit("None")).alias("kind"), word("tool").alias("tool"), obj(g("args")).alias("args"), F.coalesce(word("result"), F.lit("")).alias("result"), word("thought").alias("thought"), count(g("tokens")).alias("tokens"), count(g("latency_ms")).alias("latency_ms"), word("error").alias("error"), word("agent").alias("agent"), obj(g("meta")).alias("meta"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """raw, v (null where it is no JSON) of each line that isn't blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"), F.try_parse_json("value").alias("v"))


def kind_of(v: Column) -> Column:
    """native, openai, messages, otel or null, by what the record holds."""
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return F.when(_is(v, "ARRAY"), "messages").when(_is(v, "OBJECT"), F.when(has("resourceSpans"), "otel").when(has("steps"), "native").when(has("messages"), "openai"))


def rejected(rows: DataFrame) -> DataFrame:
    """raw, why of lines that are no record."""
    steps = F.try_variant_get("v", "$.steps", "variant")
    why = F.when(F.col("v").isNull(), "not JSON").when(kind_of(F.col("v")).isNull(), "not a record").when((kind_of(F.col("v")) == "native") & ~_is(steps, "ARRAY"), "steps are no list")
    return rows.select("raw", why.alias("why")).where("why is not null")


def native(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    good = rows.where((kind_of(v) == "native") & _is(get("steps"), "ARRAY"))
    parsed = F.transform(F.slice(F.try_variant_get(v, "$.steps", "array<variant>"), 1, MOST_STEPS), lambda s: F.struct(*(F.try_variant_get(s, f"$.{k}", "variant").alias(k) for k in ("kind", "tool", "args", "result", "thought", "tokens", "latency_ms", "error", "agent", "meta"))))
    return good.select(F.coalesce(_text(get("id")), F.substring(F.sha2("raw", 256), 1, 12)).alias("trace_id"), _text(get("task")).alias("task"), epoch(get("created_at")).alias("created_at"), F.coalesce(_text(get("model")), F.lit("unknown")).alias("model"), outcome(get("success")).alias("success"), _text(get("final_output")).alias("final_output"), obj(get("meta")).alias("meta"), F.transform(parsed, _step).alias("steps"))


_CALL = "struct<id:string,function:struct<name:string,arguments:string>>"
_MESSAGE = f"struct<role:string,content:string,name:string,tool_call_id:string,is_error:boolean,tool_calls:array<{_CALL}>>"


def _plain(kind: Column | str, tool: Column, args: Column, result: Column, thought: Column, error: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("kind"), tool.alias("tool"), args.alias("args"), F.substring(F.coalesce(result, F.lit("")), 1, MOST_TEXT).alias("result"), thought.alias("thought"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("latency_ms"), error.alias("error"), none.alias("agent"), F.lit("{}").alias("meta"))


def _message_steps(m: Column) -> Column:
    """The calls an assistant makes, each a step (arguments that are no object as {"raw": ...}), then its text as a response; a
    tool's answer as an observation; anything else as a message."""
    g, none = m.getField, F.lit(None).cast("string")
    text = F.coalesce(g("content"), F.lit(""))
    bad = F.when(F.coalesce(g("is_error"), F.lit(False)), text)

    def call(c: Column) -> Column:
        given = c.getField("function").getField("arguments")
        parsed = F.try_parse_json(given)
        args = F.when(_is(parsed, "OBJECT"), F.to_json(parsed)).otherwise(F.to_json(F.struct(given.alias("raw"))))
        return _plain("tool_call", c.getField("function").getField("name"), args, none, none, none)

    calls = F.transform(F.coalesce(g("tool_calls"), F.array().cast(f"array<{_CALL}>")), call)
    one = F.when(g("role") == "assistant", F.when(text != "", F.array(_plain(F.when(bad.isNotNull(), "error").otherwise("response"), none, F.lit("{}"), text, none, bad))).otherwise(F.array().cast(f"array<{STEP}>"))).when(g("role") == "tool", F.array(_plain("observation", g("name"), F.lit("{}"), text, none, bad))).otherwise(F.array(_plain("message", none, F.lit("{}"), text, none, none)))
    return F.when(g("role") == "assistant", F.concat(calls, one)).otherwise(one)


def chats(rows: DataFrame) -> DataFrame:
    """Chat transcripts, one a line: an object with messages and metadata, or a bare list of messages."""
    v, kind = F.col("v"), kind_of(F.col("v"))
    given = rows.where(kind.isin("openai", "messages")).withColumn("m", F.from_json(F.to_json(F.when(kind == "messages", v).otherwise(F.try_variant_get(v, "$.messages", "variant"))), f"array<{_MESSAGE}>"))
    meta = lambda k: F.when(kind == "openai", F.try_variant_get(v, f"$.metadata.{k}", "variant"))
    first = F.try_element_at(F.filter("m", lambda m: (m.getField("role") == "user") & (F.coalesce(m.getField("content"), F.lit("")) != "")), F.lit(1)).getField("content")
    failed = F.exists("m", lambda m: (m.getField("role") == "tool") & F.coalesce(m.getField("is_error"), F.lit(False)))
    told = F.when(_is(meta("success"), "BOOLEAN"), F.try_variant_get(meta("success"), "$", "boolean"))
    own = _text(meta("trace_id"))
    return given.where("m is not null").select(F.when(own.rlike("^[0-9a-f]{12}$"), own).otherwise(F.substring(F.sha2("raw", 256), 1, 12)).alias("trace_id"), F.coalesce(_text(meta("task")), F.substring(first, 1, 200)).alias("task"), F.lit(0.0).alias("created_at"), F.lit("unknown").alias("model"), F.coalesce(told, ~failed).alias("success"), F.lit(None).cast("string").alias("final_output"), F.lit("{}").alias("meta"), F.slice(F.flatten(F.transform("m", _message_steps)), 1, MOST_STEPS).alias("steps"))


_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:array<struct<key:string,value:{_VALUE}>>>"
_OTLP = f"struct<resourceSpans:array<struct<scopeSpans:array<struct<spans:array<{_SPAN}>>>>>>"


def otlp(rows: DataFrame, prefix: str = "agent") -> DataFrame:
    """Spans by trace: the root (without a parent, else the first) gives task and outcome, the others the steps, in the order
    of their starts. A span of unknown kind that used tokens is a call, else a message. prefix: of the recorder's own
    attributes (kind, tool, args, result, thought, tokens, task, agent)."""
    doc = rows.where(kind_of(F.col("v")) == "otel").select(F.from_json("raw", _OTLP).alias("d"))
    spans = doc.select(F.explode("d.resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x")).select("x.*")
    attr = lambda k: F.try_element_at(F.filter("attributes", lambda a: a.getField("key") == k), F.lit(1)).getField("value")
    word = lambda k: F.coalesce(attr(k).getField("stringValue"), attr(k).getField("intValue"), attr(k).getField("doubleValue").cast("string"))
    number = lambda k: F.coalesce(attr(k).getField("intValue").try_cast("bigint"), attr(k).getField("doubleValue").cast("bigint"))
    parts = sum((F.coalesce(number(f"gen_ai.usage.{k}"), F.lit(0)) for k in ("output_tokens", "prompt_tokens", "input_tokens")), F.coalesce(number("gen_ai.usage.completion_tokens"), F.lit(0)))
    used = F.coalesce(number(f"{prefix}.tokens"), number("gen_ai.usage.total_tokens"), parts)
    start, end = F.col("startTimeUnixNano").try_cast("bigint"), F.col("endTimeUnixNano").try_cast("bigint")
    known = word(f"{prefix}.kind")
    kind = F.when(known.isin("plan", "tool_call", "observation", "response", "error", "message"), known).otherwise(F.when(used > 0, "tool_call").otherwise("message"))
    flat = spans.select(F.col("traceId").alias("trace"), F.coalesce("parentSpanId", F.lit("")).alias("parent"), F.coalesce(start, F.lit(0)).alias("start"), "spanId", "name", F.col("status.code").alias("code"), word(f"{prefix}.task").alias("task"), F.struct(kind.alias("kind"), F.coalesce(word(f"{prefix}.tool"), word("gen_ai.tool.name"), F.col("name")).alias("tool"), F.coalesce(word(f"{prefix}.args"), F.lit("{}")).alias("args"), F.substring(F.coalesce(word(f"{prefix}.result"), F.lit("")), 1, MOST_TEXT).alias("result"), word(f"{prefix}.thought").alias("thought"), F.least(F.greatest(used, F.lit(0)), F.lit(CAP)).alias("tokens"), F.least(F.greatest(F.coalesce(F.floor((end - start) / 1_000_000), F.lit(0)), F.lit(0)), F.lit(CAP)).cast("bigint").alias("latency_ms"), F.when(F.col("status.code") == 2, "error").alias("error"), word(f"{prefix}.agent").alias("agent"), F.lit("{}").alias("meta")).alias("step"))
    rooted = flat.groupBy("trace").agg(F.min_by(F.struct("spanId", "code", "start", F.coalesce("task", "name").alias("task")), F.struct(F.col("parent") != "", "start", "spanId")).alias("root"), F.sort_array(F.collect_list(F.struct("start", "spanId", "step"))).alias("all"))
    others = F.transform(F.filter("all", lambda s: s.getField("spanId") != F.col("root.spanId")), lambda s: s.getField("step"))
    return rooted.select(F.substring(F.sha2("trace", 256), 1, 12).alias("trace_id"), F.col("root.task").alias("task"), (F.col("root.start") / 1e9).alias("created_at"), F.lit("unknown").alias("model"), F.when(F.col("root.code") == 2, False).when(F.col("root.code") == 1, True).alias("success"), F.lit(None).cast("string").alias("final_output"), F.lit("{}").alias("meta"), F.slice(others, 1, MOST_STEPS).alias("steps"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files, whatever their kinds, each id once: the first by content where they differ."""
    rows = lines(spark, path)
    every = native(rows).unionByName(chats(rows)).unionByName(otlp(rows))
    content = F.to_json(F.struct(*every.columns))
    first = F.row_number().over(W.partitionBy("trace_id").orderBy(content))
    return every.where(F.col("trace_id").rlike(SAFE_ID)).withColumn("nth", first).where("nth = 1").drop("nth")


def new_records(records: DataFrame, store: DataFrame) -> DataFrame:
    """Those whose id the store doesn't have yet."""
    return records.join(store.select("trace_id"), "trace_id", "left_anti")


def exploded(records: DataFrame) -> DataFrame:
    """One row for each step, with its place."""
    return records.select("trace_id", F.posexplode("steps").alias("step_index", "s")).select("trace_id", "step_index", "s.*")


def steps_and_traces(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps and traces of recorded runs with the columns that the rules and rollups read; what a run's or a step's meta holds
    (mutating, verify, share_with, from_agent, to_agent, requires_ack; role_tools, agents, forbidden_tools, ambiguous,
    step_limit, budget) becomes columns. A call checks where it says so, or its tool's name does."""
    of = lambda k, kind, column="meta": F.from_json(F.get_json_object(column, f"$.{k}"), kind)
    flag = lambda k: F.coalesce(F.get_json_object("meta", f"$.{k}") == "true", F.lit(False))
    word = lambda k: F.get_json_object("meta", f"$.{k}")
    rows = records.select("trace_id", "task", "model", "created_at", F.posexplode("steps").alias("step_index", "s")).select("trace_id", "task", "model", "created_at", F.col("step_index").cast("long").alias("step_index"), "s.*")
    call = F.col("kind") == "tool_call"
    check = flag("verify") | F.coalesce(F.lower("tool").rlike("^(get|verify|check|confirm|validate|read)_"), F.lit(False))
    steps = rows.select(
        "trace_id", F.lit("records").alias("store"), "step_index", "kind", "tool", F.to_json(F.try_parse_json("args")).alias("args_canon"), "result", "thought", "tokens", "latency_ms", "error",
        F.coalesce("agent", word("agent")).alias("agent"), word("from_agent").alias("from_agent"), word("to_agent").alias("to_agent"), flag("requires_ack").alias("requires_ack"), of("share_with", "array<string>").alias("share_with"),
        (call & flag("mutating")).alias("mutating"), (call & check).alias("is_verify"), "task", "model", (F.col("created_at") * 1e6).cast("long").alias("ts_us"),
    ).withColumn("fingerprint", F.concat_ws(":", "kind", F.coalesce("tool", F.lit("None")), "args_canon"))
    ends = steps.groupBy("trace_id").agg(F.count("*").alias("n_steps"), F.sum("tokens").alias("tokens"), F.sum("latency_ms").alias("duration"), F.max_by("kind", "step_index").alias("last_kind"), F.max("step_index").alias("last_index"))
    traces = records.select(
        "trace_id", F.lit("records").alias("store"), "task", "model", "success", (F.col("created_at") * 1e6).cast("long").alias("created_us"),
        of("role_tools", "map<string,array<string>>").alias("role_tools"), of("agents", "map<string,string>").alias("agent_roles"), of("forbidden_tools", "array<string>").alias("forbidden"), flag("ambiguous").alias("ambiguous"),
        word("step_limit").try_cast("long").alias("step_limit"), F.coalesce(word("budget.exceeded") == "true", F.lit(False)).alias("breached"), F.lit(False).alias("annotated"),
    )
    return steps, traces.join(ends, "trace_id")
