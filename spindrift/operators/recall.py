"""Looking back over runs: timelines, search, summaries, topics, related runs, redaction and tool-text scans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import day_of

STOP = ("the", "and", "for", "with", "from", "that", "this", "you", "are", "was")
WORD = r"[a-z][-._0-9a-z]{2,}"
REDACTIONS = [("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), ("CARD", r"\b[0-9]{16}\b"), ("HEX", r"\b[0-9a-f]{40}\b")]


def timeline(steps: DataFrame, traces: DataFrame, limit: int) -> DataFrame:
    """The last `limit` runs: day, task, outcome, tools, duration."""
    tools = steps.where("kind = 'tool_call'").groupBy("trace_id").agg(F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"))
    last = traces.orderBy(F.desc("created_us"), F.desc("trace_id")).limit(limit)
    outcome = F.when(F.col("success").isNull(), "unknown").when(F.col("success"), "ok").otherwise("failed")
    return last.join(tools, "trace_id", "left").select("trace_id", day_of(F.col("created_us")).alias("day"), "task", outcome.alias("outcome"), F.coalesce("tools", F.lit("")).alias("tools"), "duration")


def search(steps: DataFrame, traces: DataFrame, needle: str, cap: int = 8) -> DataFrame:
    """trace_id, step_index (-1: the task), field, excerpt of texts that contain the needle in any case, at most `cap` a run."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(i).alias("o"), F.col(f).alias("text")) for i, f in enumerate(("thought", "result", "error"))))
    inside = steps.select("trace_id", "step_index", F.explode(fields).alias("x")).select("trace_id", "step_index", "x.field", "x.o", "x.text")
    heads = traces.select("trace_id", F.lit(-1).cast("long").alias("step_index"), F.lit("task").alias("field"), F.lit(-1).alias("o"), F.col("task").alias("text"))
    hits = heads.unionByName(inside).where(F.contains(F.lower("text"), F.lit(needle.lower())))
    at = F.instr(F.lower("text"), needle.lower())
    excerpt = F.substring(F.col("text"), F.greatest(at - 60, F.lit(1)), F.lit(160))
    ranked = hits.withColumn("rn", F.row_number().over(W.partitionBy("trace_id").orderBy("step_index", "o"))).where(F.col("rn") <= cap)
    return ranked.select("trace_id", "step_index", "field", excerpt.alias("excerpt"))


def day_summary(steps: DataFrame, traces: DataFrame) -> DataFrame:
    day = day_of(F.col("created_us"))
    calls = steps.groupBy("trace_id").agg(F.count_if(F.col("kind") == "tool_call").alias("calls"))
    return traces.join(calls, "trace_id").groupBy(day.alias("day")).agg(F.count("*").alias("conversations"), F.count_if(F.col("success") == False).alias("failed"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("tool_calls"))  # noqa: E712


def topics(docs: DataFrame, group: str, text: str, n: int = 6) -> DataFrame:
    """The n most frequent words of each group, ties by the alphabet."""
    words = docs.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")).where((F.length("word") <= 32) & ~F.col("word").isin(*STOP))
    counts = words.groupBy(group, "word").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "word")).cast("long")).where(F.col("rank") <= n)


def related(steps: DataFrame, traces: DataFrame, target: str) -> DataFrame:
    """trace_id, score: the likeness of each run's tools and day to one run's. The target's tools and day are read first."""
    tools = steps.where("kind = 'tool_call'").groupBy("trace_id").agg(F.collect_set("tool").alias("tools"))
    rows = traces.select("trace_id", day_of(F.col("created_us")).alias("day")).join(tools, "trace_id", "left").withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))
    own = rows.where(F.col("trace_id") == target).first()
    if own is None:
        return rows.select("trace_id", F.lit(0.0).alias("score")).limit(0)
    mine = F.array(*map(F.lit, own.tools)) if own.tools else F.array().cast("array<string>")
    union = F.size(F.array_union("tools", mine))
    score = F.when(union > 0, F.size(F.array_intersect("tools", mine)) / union).otherwise(0.0) + F.when(F.col("day") == own.day, 0.5).otherwise(0.0)
    return rows.where(F.col("trace_id") != target).select("trace_id", score.alias("score")).where("score > 0")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The text with personal data and keys replaced by their kind, and how many of each."""
    out, counts = F.col(text), {}
    for name, pattern in REDACTIONS:
        counts[f"n_{name.lower()}"] = F.size(F.regexp_extract_all(out, F.lit(pattern), F.lit(0))).cast("long")
        out = F.regexp_replace(out, pattern, f"[{name}]")
    return docs.select("doc_id", *(c.alias(k) for k, c in counts.items()), out.alias("redacted"))


#: Kinds of secrets in the order in which they are looked for, each replaced by [REDACTED:kind].
SECRETS = [
    ("aws_key", r"\bA(?:K|S)IA[A-Z0-9]{16}\b"),
    ("gcp_key", r"\bAIza[-\w]{35}\b"),
    ("github_token", r"\bgh(?:p|o|u|s|r)_[0-9A-Za-z]{36,}\b"),
    ("openai_key", r"\bsk-[-\w]{20,}\b"),
    ("slack_token", r"\bxox(?:a|b|p|r|s)-[-0-9A-Za-z]{10,}\b"),
    ("jwt", r"\beyJ[-\w]{10,}(?:\.[-\w]{10,})(?:\.[-\w]{5,})\b"),
    ("bearer", r"(?i)\bbearer[\t ]+[-+./=~\w]{16,}"),
    ("kv_secret", r"(?i)\b(?:password|pass|secret|api_?key|a(?:uth|ccess)_?token)\s*[:=]\s*[\"']?[-+./=~\w]{8,}[\"']?"),
    ("private_key", r"-----BEGIN [ 0-9A-Z]*PRIVATE KEY-----(?s:.*?)-----END [ 0-9A-Z]*PRIVATE KEY-----"),
]


def secret_patterns(extra: list[str] = ()) -> list[tuple[str, str]]:
    """The built-in kinds and the caller's, each `name=pattern` or a bare pattern (then custom-1, custom-2 ...)."""
    out = dict(SECRETS)
    for i, given in enumerate(extra, 1):
        m = re.match(r"([-.\w]{1,64})=(.+)", given, re.S)
        name, pattern = (m[1], m[2]) if m else (f"custom-{i}", given)
        if not pattern:
            raise ValueError(f"pattern {name!r} is empty")
        re.compile(pattern)
        out[name] = pattern
    return list(out.items())


def redact_columns(rows: DataFrame, columns: list[str], patterns: list[tuple[str, str]] | None = None, marker: str = "[REDACTED:{name}]") -> DataFrame:
    """rows with the secrets in the columns replaced, and `hits`, how many there were. Arguments are columns of JSON text: what
    is nested in them is reached too, as no kind takes quotes or braces."""
    hits, out = F.lit(0), {}
    for c in columns:
        text = F.col(c)
        for name, pattern in patterns or secret_patterns():
            hits = hits + F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
            text = F.regexp_replace(text, pattern, marker.format(name=name))
        out[c] = text
    return rows.withColumn("hits", hits.cast("long")).withColumns(out)


TOOL_TEXT = {
    "bidi": "[\u202a-\u202e\u2066-\u2069]",
    "invisible": "[\u200b-\u200f\u2060-\u2064\ufeff]",
    "mixed_scripts": "[A-Za-z][\u0370-\u058f]|[\u0370-\u058f][A-Za-z]",
    "ignore_orders": r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|earlier|above)\s+(?:instructions|orders|rules)",
    "new_role": r"(?i)\byou\s+are\s+now\b",
    "secrecy": r"(?i)\b(?:do\s+not|don't|never)\s+(?:tell|inform|mention|reveal)",
    "system_prompt": r"(?i)\bsystem\s+prompt\b",
    "must_call": r"(?i)\balways\s+(?:call|use|invoke)\b",
    "exfiltrate": r"(?i)\b(?:send|post|upload|forward)\s+(?:it|this|them|all)\b.{0,40}\bto\b",
    "hidden_markup": r"(?i)<(?:script|iframe|important|system)\b",
    "comment": r"<!--",
}
#: Characters that no honest description needs; findings of other kinds make a text suspicious.
MALICIOUS = ("bidi", "invisible")


def tool_verdict(rows: DataFrame, text: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """rows with `findings` (kinds, in the order of the table) and `verdict`: clean, suspicious or malicious."""
    kinds = TOOL_TEXT if kinds is None else kinds
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), name) for name, p in kinds.items())))
    out = rows.withColumn("found", found)
    bad = F.arrays_overlap("found", F.array(*map(F.lit, MALICIOUS)))
    return out.withColumns({"findings": F.array_join("found", ","), "verdict": F.when(bad, "malicious").when(F.size("found") > 0, "suspicious").otherwise("clean")}).drop("found")


def tool_scan(pages: DataFrame) -> DataFrame:
    """Findings in texts that tools return: markup that runs, comments, hidden characters, orders to the reader."""
    rules = {"script": r"(?i)<script", "comment": r"<!--", "invisible": "[​-‏‪-‮⁠-⁤]", "orders": r"(?i)ignore (all )?(previous|prior) instructions"}
    hits = F.array_compact(F.array(*(F.when(F.col("html").rlike(p), name) for name, p in rules.items())))
    return pages.select("page_id", F.explode(hits).alias("finding"))


def composition(steps: DataFrame) -> DataFrame:
    """store, kind, tokens, share: what a context is made of, at four characters a token."""
    part = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.greatest(F.lit(1), F.floor(F.length(c) / 4))).otherwise(0)
    rows = steps.groupBy("store", "kind").agg(F.sum(part("result") + part("thought") + part("args_canon")).cast("long").alias("tokens"))
    return rows.withColumn("share", F.col("tokens") / F.sum("tokens").over(W.partitionBy("store")))


def budget_trip(steps: DataFrame, limit: int) -> DataFrame:
    """trace_id, tripped_at, saved: the first call at which the tokens so far exceed the limit, and those spent after it."""
    w = W.partitionBy("trace_id").orderBy("step_index")
    rows = steps.withColumns({"sofar": F.sum("tokens").over(w), "total": F.sum("tokens").over(W.partitionBy("trace_id"))})
    first = rows.where((F.col("kind") == "tool_call") & (F.col("sofar") > limit)).groupBy("trace_id").agg(F.min_by(F.struct("step_index", (F.col("total") - F.col("sofar")).alias("saved")), "step_index").alias("x"))
    return first.select("trace_id", F.col("x.step_index").alias("tripped_at"), F.col("x.saved").alias("saved"))
