"""The failure rules over tool traces: each gives at most one detection for a trace, its first.

All take the steps table of sources.adapters (or one of the same columns) and return mode_id, rule, trace_id, step_index,
confidence. Windows are partitioned by trace, so that all rules share one exchange; none compares steps of two traces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WITHIN, CYCLE_CALLS = 6, 16
STOP = ("with", "from", "that", "this", "then")
ENTITY = r"\b[A-Z]{2,}[0-9]+\b|#\w+(-\w+)*"
INTENT = r"(?i)\b(?:next|let'?s|then|now|will)\s+(?:execute|invoke|run|use|call)\s+`?([a-z_]\w{2,})`?"


def _by():
    return W.partitionBy("trace_id").orderBy("step_index")


def _after():
    """All later steps: read backwards, the frame grows by a row at a time instead of being read anew for each."""
    return W.partitionBy("trace_id").orderBy(F.desc("step_index")).rowsBetween(W.unboundedPreceding, -1)


def _hit(rows: DataFrame, mode: str, rule: str, step: Column, confidence: Column | float) -> DataFrame:
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select(F.lit(mode).alias("mode_id"), F.lit(rule).alias("rule"), "trace_id", step.cast("long").alias("step_index"), confidence.cast("double").alias("confidence"))


def _first(rows: DataFrame, mode: str, rule: str, confidence: float) -> DataFrame:
    return _hit(rows.groupBy("trace_id").agg(F.min("step_index").alias("at")), mode, rule, F.col("at"), confidence)


def _ok(steps: DataFrame) -> DataFrame:
    return steps.where("kind = 'tool_call' and error is null")


def repeat(steps: DataFrame) -> DataFrame:
    """The same call again within six steps of its last success. The count takes failed calls between the two as well."""
    same = W.partitionBy("trace_id", "fingerprint").orderBy("step_index")
    good = F.when((F.col("kind") == "tool_call") & F.col("error").isNull(), F.col("step_index"))
    # rank among all steps of the fingerprint; the difference of ranks counts what lies between
    rows = steps.select("trace_id", "fingerprint", "step_index", "kind", "error", F.row_number().over(same).alias("nth"), F.last(good, ignorenulls=True).over(same.rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    rows = rows.withColumn("nth_before", F.last(F.when(good.isNotNull(), F.col("nth")), ignorenulls=True).over(same.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.where(good.isNotNull() & (F.col("step_index") - F.col("before") <= WITHIN))
    first = rows.groupBy("trace_id").agg(F.min_by(F.struct("step_index", (F.col("nth") - F.col("nth_before") + 1).alias("n")), "step_index").alias("x"))
    return _hit(first, "FM-1.3", "repeat", F.col("x.step_index"), F.least(F.lit(0.95), 0.6 + 0.1 * F.col("x.n")))


def _longest_cycle(tools: list[str]) -> tuple[int, int]:
    """Calls in the longest run of back-to-back equal blocks of two to six calls, and where it ends."""
    best, end = 0, 0
    for period in range(2, 7):
        run = at = 0
        while at + 2 * period <= len(tools):
            ahead = at + period
            if tools[at:ahead] != tools[ahead : ahead + period]:
                run, at = 0, at + 1
                continue
            run += period if run else 2 * period
            if run > best:
                best, end = run, ahead + period
            at = ahead
    return best, end


def _series(steps: DataFrame) -> DataFrame:
    """trace_id, c: the successful calls of runs that have enough of them, in order."""
    return _ok(steps).groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("step_index", F.coalesce("tool", F.lit("?")).alias("tool")))).alias("c")).where(F.size("c") >= CYCLE_CALLS)


def _cycles(series: DataFrame, by: dict[str, str]) -> DataFrame:
    """by: the columns that tell runs apart, with their types."""
    names = ["mode_id", "rule", *by, "step_index", "confidence"]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for at, tools, *run_of in zip(part["at"], part["tools"], *(part[x] for x in by)):
                run, end = _longest_cycle(list(tools))
                if run >= CYCLE_CALLS:
                    out.append(("FM-1.3", "cycle", *run_of, int(at[end - run]), min(0.02 * run + 0.5, 0.85)))
            yield pd.DataFrame(out, columns=names)

    rows = series.select(*by, F.col("c.step_index").alias("at"), F.col("c.tool").alias("tools"))
    return rows.mapInPandas(scan, f"mode_id string, rule string, {', '.join(f'{x} {t}' for x, t in by.items())}, step_index long, confidence double")


def cycle(steps: DataFrame) -> DataFrame:
    """Blocks of two to six calls that repeat back to back over 16 calls or more. The greedy scan depends on its order, so
    that it runs in Python, on traces with enough calls only."""
    return _cycles(_series(steps), {"trace_id": "string"})


def long_loop(steps: DataFrame, traces: DataFrame) -> DataFrame:
    """A call made three times or more, wider apart than six steps; else a step limit reached without a response."""
    loops = _ok(steps).groupBy("trace_id", "fingerprint").agg(F.count("*").alias("n"), F.min("step_index").alias("a"), F.max("step_index").alias("b")).where(f"n >= 3 and b - a > {WITHIN}")
    first = loops.groupBy("trace_id").agg(F.min_by("b", "a").alias("b"))
    both = traces.join(first, "trace_id", "left").where("b is not null or (n_steps >= step_limit and last_kind <> 'response')")
    return _hit(both, "FM-1.5", "long_loop", F.coalesce("b", "last_index"), F.when(F.col("b").isNotNull(), 0.65).otherwise(0.6))


def reset(steps: DataFrame) -> DataFrame:
    return _first(steps.where((F.col("step_index") > 0) & (F.col("kind") == "plan") & (F.lower(F.trim("thought")) == F.lower(F.trim("task")))), "FM-2.1", "reset", 0.75)


def premature(traces: DataFrame) -> DataFrame:
    rows = traces.where("success = false and last_kind in ('response', 'error')")
    return _hit(rows, "FM-3.1", "premature", F.col("last_index"), F.when(F.col("last_kind") == "response", 0.7).otherwise(0.8))


def missing_verify(steps: DataFrame) -> DataFrame:
    rows = steps.withColumn("next", F.max("is_verify").over(_after())).where("mutating and error is null and not coalesce(next, false)")
    return _first(rows, "FM-3.2", "missing_verify", 0.7)


def weak_verify(steps: DataFrame) -> DataFrame:
    claim = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    seen = F.when(F.col("is_verify"), F.struct("step_index", F.coalesce("error", "result", F.lit("")).alias("said")))
    rows = steps.withColumn("next", F.last(seen, ignorenulls=True).over(_after())).where("mutating and error is null and next is not null")
    rows = rows.where((claim(F.col("result")) == claim(F.col("next.said"))) & (claim(F.col("result")) != ""))
    first = rows.groupBy("trace_id").agg(F.min_by("next.step_index", "step_index").alias("at"))
    return _hit(first, "FM-3.3", "weak_verify", F.col("at"), 0.6)


def intent_mismatch(steps: DataFrame) -> DataFrame:
    """A tool announced in the thought and another one called; the announced one has an underscore or is called elsewhere."""
    said = F.lower(F.regexp_extract("thought", INTENT, 1))
    known = F.collect_set(F.when(F.col("kind") == "tool_call", F.col("tool"))).over(W.partitionBy("trace_id"))
    rows = steps.withColumn("known", known).where("kind = 'tool_call' and thought is not null and tool is not null")
    rows = rows.where((said != "") & (said != F.lower("tool")) & (said.contains("_") | F.array_contains("known", said)))
    return _first(rows, "FM-2.6", "intent_mismatch", 0.65)


def derail(steps: DataFrame) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("task"), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOP)))
    text = F.lower(F.concat_ws(" ", "tool", "args_canon"))
    calls = steps.where("kind = 'tool_call'").withColumns({"words": words, "text": text}).where(F.size("words") > 0)
    off = ~F.exists("words", lambda w: F.contains(F.col("text"), w))
    rows = calls.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(off).alias("off"), F.min(F.when(off, F.col("step_index"))).alias("at")).where("n >= 3 and off >= 0.5 * n")
    return _hit(rows, "FM-2.3", "derail", F.col("at"), F.least(F.lit(0.55), 0.35 + 0.2 * F.col("off") / F.col("n")))


def forbidden(steps: DataFrame, traces: DataFrame) -> DataFrame:
    rows = steps.where("kind = 'tool_call'").join(traces.where("forbidden is not null").select("trace_id", "forbidden"), "trace_id").where("array_contains(forbidden, tool)")
    return _first(rows, "FM-1.1", "forbidden", 1.0)


def _unclear() -> Column:
    """A task that asks for a choice, or one that is marked as ambiguous."""
    task = F.lower("task")
    return (task.contains(" or ") & (task.contains("?") | task.contains("either"))) | F.coalesce("ambiguous", F.lit(False))


def clarify(steps: DataFrame, traces: DataFrame) -> DataFrame:
    unclear = steps.join(traces.select("trace_id", "ambiguous"), "trace_id").where(_unclear())
    asked = F.coalesce(F.contains("thought", F.lit("?")), F.lit(False)) | F.coalesce(F.contains("result", F.lit("?")), F.lit(False))
    rows = unclear.groupBy("trace_id").agg(F.coalesce(F.min(F.when(F.col("mutating"), F.col("step_index"))), F.max("step_index")).alias("at"), F.max(asked).alias("asked")).where("not asked")
    return _hit(rows, "FM-2.2", "clarify", F.col("at"), 0.55)


def withhold(steps: DataFrame) -> DataFrame:
    """A result to be shared that its owner sends no message about later, though the agent it was for goes on acting."""
    senders = F.collect_set(F.when(F.col("kind") == "message", F.col("from_agent"))).over(_after())
    actors = F.collect_set(F.when(F.col("kind").isin("tool_call", "plan"), F.col("agent"))).over(_after())
    rows = steps.withColumns({"senders": senders, "actors": actors}).where("kind = 'tool_call' and share_with is not null")
    return _first(rows.where(~F.array_contains("senders", F.coalesce("agent", F.lit("unknown"))) & F.arrays_overlap("actors", F.col("share_with"))), "FM-2.4", "withhold", 0.6)


def ignored(steps: DataFrame) -> DataFrame:
    actors = F.collect_set(F.when(F.col("kind") != "message", F.col("agent"))).over(_after())
    rows = steps.withColumn("actors", actors).where("requires_ack and to_agent is not null")
    return _first(rows.where(~F.array_contains("actors", F.col("to_agent"))), "FM-2.5", "ignored", 0.65)


def role(steps: DataFrame, traces: DataFrame) -> DataFrame:
    """A call of a tool that the caller's role (its own name, where it has none) isn't allowed; roles without a list may all."""
    rows = steps.where("kind = 'tool_call' and tool is not null").join(traces.where("role_tools is not null").select("trace_id", "role_tools", "agent_roles"), "trace_id")
    return _first(rows.where(_off_role()), "FM-1.2", "role", 0.85)


def _off_role() -> Column:
    allowed = F.element_at("role_tools", F.coalesce(F.element_at("agent_roles", F.col("agent")), F.col("agent")))
    return F.coalesce(~F.array_contains(allowed, F.col("tool")), F.lit(False))


def _entities(steps: DataFrame, *more: str) -> DataFrame:
    """A row for each identifier that a step names: trace_id, step_index, entity, told (its result has it), bare (it isn't a
    call), more of the step's columns."""
    found = lambda c: F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0))
    result, named = found(F.coalesce("result", F.lit(""))), found(F.concat_ws(" ", "thought", "result"))
    rows = steps.select("trace_id", "step_index", *more, (F.col("kind") != "tool_call").alias("bare"), result.alias("told"), F.explode(F.array_distinct(named)).alias("entity"))
    return rows.withColumn("told", F.array_contains("told", F.col("entity")))


def _lost(entities: DataFrame, by: list[str]) -> DataFrame:
    """by and `at`: where an identifier is first named, other than by a call and at the start, if no earlier result has it."""
    idx = F.col("step_index")
    each = entities.groupBy(*by, "entity").agg(F.min(F.when(F.col("told"), idx)).alias("since"), F.min(F.when(F.col("bare") & (idx > 0), idx)).alias("at"))
    return each.where("at is not null and coalesce(since >= at, true)").groupBy(*by).agg(F.min("at").alias("at"))


def lost_reference(steps: DataFrame) -> DataFrame:
    """An identifier named, other than by a call, that no earlier result has."""
    return _hit(_lost(_entities(steps), ["trace_id"]), "FM-1.4", "lost_reference", F.col("at"), 0.55)


def _facts(steps: DataFrame, traces: DataFrame, *more: str) -> DataFrame:
    """Of each step what the rules ask of it by itself, worked out once; of its texts only those that two steps are compared by,
    and more of its columns where named."""
    call, tool = F.col("kind") == "tool_call", F.col("tool")
    rows = steps.join(traces.select("trace_id", "success", "n_steps", "last_kind", "last_index", "step_limit", "forbidden", "role_tools", "agent_roles", "ambiguous"), "trace_id")
    words = F.array_distinct(F.filter(F.split(F.lower("task"), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOP)))
    claim = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    change = F.col("mutating") & F.col("error").isNull()
    rows = rows.withColumns({
        "words": F.when(call, words),
        "text": F.when(call, F.lower(F.concat_ws(" ", "tool", "args_canon"))),
        "said": F.when(call, F.lower(F.regexp_extract(F.coalesce("thought", F.lit("")), INTENT, 1))),
        "claim": F.when(change, claim(F.col("result"))),
    })
    topical = call & (F.size("words") > 0)
    asked = F.coalesce(F.contains("thought", F.lit("?")), F.lit(False)) | F.coalesce(F.contains("result", F.lit("?")), F.lit(False))
    return rows.select(
        "trace_id", "step_index", "fingerprint", "success", "n_steps", "last_kind", "last_index", "step_limit", "mutating", "agent", *more,
        (call & F.col("error").isNull()).alias("good"),
        change.alias("change"),
        F.when(F.col("claim") != "", F.col("claim")).alias("claim"),
        F.when(F.col("is_verify"), claim(F.coalesce("error", "result", F.lit("")))).alias("check"),
        ((F.col("kind") == "plan") & (F.lower(F.trim("thought")) == F.lower(F.trim("task")))).alias("resets"),
        F.when(call & (F.col("said") != "") & (F.col("said") != F.lower(tool)), F.col("said")).alias("announced"),
        F.when(call, tool).alias("tool"),
        topical.alias("topical"),
        (topical & ~F.exists("words", lambda w: F.contains(F.col("text"), w))).alias("off"),
        (call & F.array_contains("forbidden", tool)).alias("forbidden"),
        _unclear().alias("unclear"),
        asked.alias("asked"),
        F.when(F.col("kind") == "message", F.col("from_agent")).alias("from_agent"),
        F.col("kind").isin("tool_call", "plan").alias("does"),
        (F.col("kind") != "message").alias("acts"),
        F.when(call, F.col("share_with")).alias("share_with"),
        F.when(F.col("requires_ack"), F.col("to_agent")).alias("waits"),
        (call & tool.isNotNull() & _off_role()).alias("off_role"),
    )


def _judged(rows: DataFrame, by: list[str], counted: bool = False) -> DataFrame:
    """The detections of all rules but lost references and cycles; by: the columns that tell runs apart. counted: a run's length
    and last step are those of the rows (which have `kind`), not those of its trace."""
    c, idx = F.col, F.col("step_index")
    ends = {"n_steps": F.count("*"), "last_kind": F.max_by("kind", idx), "last_index": F.max(idx)} if counted else {x: F.first(x) for x in ("n_steps", "last_kind", "last_index")}
    same = W.partitionBy(*by, "fingerprint").orderBy("step_index")
    earlier, so_far = same.rowsBetween(W.unboundedPreceding, -1), same.rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*by).orderBy(F.desc("step_index")).rowsBetween(W.unboundedPreceding, -1)
    ok_at = F.when(c("good"), idx)
    rows = rows.withColumn("nth", F.row_number().over(same))
    rows = rows.withColumns({"before": F.last(F.when(c("good"), F.struct("step_index", "nth")), ignorenulls=True).over(earlier), "made": F.count(ok_at).over(so_far), "made_first": F.min(ok_at).over(so_far)})
    rows = rows.withColumns({
        "again": F.when(c("good") & (idx - c("before.step_index") <= WITHIN), c("nth") - c("before.nth") + 1),
        # what is so at a call is so at the last one like it, which is the latest
        "looped": F.when(c("good") & (c("made") >= 3) & (idx - c("made_first") > WITHIN), c("made_first")),
    }).drop("fingerprint", "nth", "before", "made", "made_first")
    rows = rows.withColumns({
        "next": F.last(F.when(c("check").isNotNull(), F.struct("step_index", "check")), ignorenulls=True).over(after),
        "senders": F.collect_set("from_agent").over(after),
        "doers": F.collect_set(F.when(c("does"), c("agent"))).over(after),
        "actors": F.collect_set(F.when(c("acts"), c("agent"))).over(after),
        "tools": F.collect_set("tool").over(W.partitionBy(*by)),
    })
    first = lambda condition: F.min(F.when(condition, idx))
    per = rows.groupBy(*by).agg(
        F.min(F.when(c("again").isNotNull(), F.struct("step_index", c("again").alias("n")))).alias("again"),
        F.min(F.when(c("looped").isNotNull(), F.struct("looped", (-idx).alias("less")))).alias("loop"),
        *(x.alias(name) for name, x in ends.items()), F.first("success").alias("success"), F.first("step_limit").alias("step_limit"),
        first((idx > 0) & c("resets")).alias("reset"),
        first(c("change") & c("next").isNull()).alias("unverified"),
        F.min(F.when(c("change") & (c("claim") == c("next.check")), F.struct("step_index", c("next.step_index").alias("at")))).alias("weak"),
        first(c("announced").contains("_") | F.array_contains("tools", c("announced"))).alias("mismatch"),
        F.count_if("topical").alias("topical"), F.count_if("off").alias("off"), first(c("off")).alias("off_at"),
        first(c("forbidden")).alias("forbidden"),
        F.coalesce(first(c("mutating")), F.max(idx)).alias("commit"), F.max("unclear").alias("unclear"), F.max("asked").alias("asked"),
        first(c("share_with").isNotNull() & ~F.array_contains("senders", F.coalesce("agent", F.lit("unknown"))) & F.arrays_overlap("doers", "share_with")).alias("withheld"),
        first(c("waits").isNotNull() & ~F.array_contains("actors", c("waits"))).alias("ignored"),
        first(c("off_role")).alias("off_role"),
    )

    def found(mode: str, rule: str, step: Column, confidence: Column | float, condition: Column | None = None) -> Column:
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        hit = F.struct(F.lit(mode).alias("mode_id"), F.lit(rule).alias("rule"), step.cast("long").alias("step_index"), confidence.cast("double").alias("confidence"))
        return F.when(step.isNotNull() if condition is None else condition & step.isNotNull(), hit)

    looped = c("loop").isNotNull()
    spent = F.coalesce((c("n_steps") >= c("step_limit")) & (c("last_kind") != "response"), F.lit(False))
    hits = F.array(
        found("FM-1.3", "repeat", c("again.step_index"), F.least(F.lit(0.95), 0.6 + 0.1 * c("again.n"))),
        found("FM-1.5", "long_loop", F.coalesce(-c("loop.less"), c("last_index")), F.when(looped, 0.65).otherwise(0.6), looped | spent),
        found("FM-2.1", "reset", c("reset"), 0.75),
        found("FM-3.1", "premature", c("last_index"), F.when(c("last_kind") == "response", 0.7).otherwise(0.8), (c("success") == False) & c("last_kind").isin("response", "error")),  # noqa: E712
        found("FM-3.2", "missing_verify", c("unverified"), 0.7),
        found("FM-3.3", "weak_verify", c("weak.at"), 0.6),
        found("FM-2.6", "intent_mismatch", c("mismatch"), 0.65),
        found("FM-2.3", "derail", c("off_at"), F.least(F.lit(0.55), 0.35 + 0.2 * c("off") / F.greatest("topical", F.lit(1))), (c("topical") >= 3) & (c("off") >= 0.5 * c("topical"))),
        found("FM-1.1", "forbidden", c("forbidden"), 1.0),
        found("FM-2.2", "clarify", c("commit"), 0.55, c("unclear") & ~c("asked")),
        found("FM-2.4", "withhold", c("withheld"), 0.6),
        found("FM-2.5", "ignored", c("ignored"), 0.65),
        found("FM-1.2", "role", c("off_role"), 0.85),
    )
    return per.select(*by, F.explode(F.array_compact(hits)).alias("x")).select("x.mode_id", "x.rule", *by, "x.step_index", "x.confidence")


def run_rules(steps: DataFrame, traces: DataFrame, cycles: bool = True) -> DataFrame:
    """All detections, in one pass: after the exchange by trace, every window and the aggregate keep that partitioning.
    Gives what the rules above give one by one."""
    out = _judged(_facts(steps, traces), ["trace_id"]).unionByName(lost_reference(steps))
    return out.unionByName(cycle(steps)) if cycles else out
