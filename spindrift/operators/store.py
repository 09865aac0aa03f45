"""What a store of runs takes in, gives out and throws away: lookups, windows, upserts, merges, notes, retention, manifests.

All are plans over traces (trace_id, created_us, success, model, ...) and notes (trace_id, ts_us, author, verdict, note);
writing their rows is the caller's. Where two rows compete, the rule that picks one is total, so that results don't
depend on partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import DAY_US, day_of

SAFE_ID = r"^[0-9A-Za-z][-.0-9A-Z_a-z]*$"
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def lookup(traces: DataFrame, trace_id: str) -> DataFrame:
    """The run of that id; an id that could be a path is refused."""
    if ".." in trace_id or not re.match(SAFE_ID, trace_id):
        raise ValueError(f"unsafe id {trace_id!r}")
    return traces.where(F.col("trace_id") == trace_id)


def since(text: str, now: float) -> float:
    """Seconds since the epoch of `1700000000`, or of `36h`, `1.5d` and the like before now."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([smhdw])", text.strip())
    if m:
        return now - float(m[1]) * UNITS[m[2]]
    value = float(text)
    if value != value or abs(value) == float("inf"):
        raise ValueError(f"no time: {text!r}")
    return value


def window(traces: DataFrame, since_us: int | None = None, until_us: int | None = None, model: str | None = None, outcomes: str = "all", day: str | None = None) -> DataFrame:
    """Runs within a window (both ends count), of a day, of models whose name has a part in any case, of an outcome."""
    if outcomes not in ("all", "ok", "failed"):
        raise ValueError(f"outcomes are all, ok or failed, not {outcomes!r}")
    out, at = traces, F.col("created_us")
    if since_us is not None:
        out = out.where(at >= since_us)
    if until_us is not None:
        out = out.where(at <= until_us)
    if day is not None:
        out = out.where(day_of(at) == day)
    if model:
        out = out.where(F.contains(F.lower(F.coalesce("model", F.lit(""))), F.lit(model.lower())))
    return out if outcomes == "all" else out.where(F.col("success") == (outcomes == "ok"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store's rows, those of ids that are given anew replaced. Both have the same columns; new ids are unique."""
    return store.join(new.select("trace_id"), "trace_id", "left_anti").unionByName(new)


def merged(source: DataFrame, target: DataFrame, on_conflict: str = "skip") -> DataFrame:
    """trace_id, content of the target after a merge of the source (trace_id, content, sound). Sources that aren't sound (a
    broken chain) stay out; equal contents are one. Where contents conflict, the target's stays (skip), the source's
    comes in its place (replace), or comes beside it under the first free name -m2, -m3 ... (rename)."""
    if on_conflict not in ("skip", "replace", "rename"):
        raise ValueError(f"unknown policy {on_conflict!r}")
    given = source.where("sound").select("trace_id", F.col("content").alias("theirs"))
    both = given.join(target.select("trace_id", F.col("content").alias("ours")), "trace_id", "full_outer")
    clash = F.col("ours").isNotNull() & F.col("theirs").isNotNull() & (F.col("ours") != F.col("theirs"))
    kept = F.when(clash, F.col("theirs") if on_conflict == "replace" else F.col("ours")).otherwise(F.coalesce("ours", "theirs"))
    out = both.select("trace_id", kept.alias("content"))
    if on_conflict != "rename":
        return out
    # numbers that are taken, by their stem; the first that isn't is one of the first n + 1
    stem, number = F.regexp_extract("trace_id", r"^(.*)-m([0-9]+)$", 1), F.regexp_extract("trace_id", r"^(.*)-m([0-9]+)$", 2)
    taken = both.where(stem != "").groupBy(stem.alias("trace_id")).agg(F.collect_set(number.try_cast("int")).alias("taken"))
    free = F.array_min(F.array_except(F.sequence(F.lit(2), F.size("taken") + 2), F.col("taken")))
    extra = both.where(clash).join(taken, "trace_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    return out.unionByName(extra.select(F.concat("trace_id", F.lit("-m"), free.cast("string")).alias("trace_id"), F.col("theirs").alias("content")))


# notes


def new_notes(notes: DataFrame, have: DataFrame) -> DataFrame:
    """Notes to append: verdicts in small letters, each (trace, note, author, verdict) once, the earliest, and only if new."""
    key = ["trace_id", "note", "author", "verdict"]
    given = notes.withColumn("verdict", F.lower("verdict")).groupBy(*key).agg(F.min("ts_us").alias("ts_us"))
    return given.join(have.withColumn("verdict", F.lower("verdict")).select(*key), key, "left_anti")


def listing(notes: DataFrame, trace_id: str | None = None, verdict: str | None = None) -> DataFrame:
    out = notes.withColumn("verdict", F.lower("verdict"))
    if trace_id is not None:
        out = out.where(F.col("trace_id") == trace_id)
    return out if verdict is None else out.where(F.col("verdict") == verdict.lower())


def orphans(notes: DataFrame, traces: DataFrame) -> DataFrame:
    """trace_id, notes: how many notes stand on runs that the store doesn't have."""
    return notes.join(traces.select("trace_id"), "trace_id", "left_anti").groupBy("trace_id").agg(F.count("*").alias("notes"))


def coverage(traces: DataFrame, notes: DataFrame) -> DataFrame:
    """failures, annotated, owed, share: of the failed runs, those with a note."""
    has = notes.select("trace_id").distinct().withColumn("noted", F.lit(True))
    rows = traces.where("success = false").join(has, "trace_id", "left")
    out = rows.agg(F.count("*").alias("failures"), F.count("noted").alias("annotated"))
    return out.withColumns({"owed": F.col("failures") - F.col("annotated"), "share": F.when(F.col("failures") > 0, F.round(F.col("annotated") / F.col("failures"), 4))})


def line_health(lines: DataFrame) -> DataFrame:
    """total, corrupt: lines (value) that are no JSON objects; blank ones don't count."""
    bad = ~F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_parse_json("value")), "^[A-Z]+", 0) == "OBJECT", F.lit(False))
    return lines.where(F.trim("value") != "").agg(F.count("*").alias("total"), F.count_if(bad).alias("corrupt"))


def drafts(triage: DataFrame, top: int) -> DataFrame:
    """trace_id, author, verdict, note: notes to be looked at, for the first `top` failures without one."""
    rows = triage.where("not annotated").orderBy(F.desc("score"), "trace_id").limit(top)
    return rows.select("trace_id", F.lit("machine").alias("author"), F.lit("draft").alias("verdict"), F.concat(F.lit("looks like "), "mode").alias("note"))


# what goes


def retired(plan: DataFrame, traces: DataFrame) -> DataFrame:
    """Runs that a retention plan (trace_id, fate) takes out and that are still unguarded: fates that speak of an age past."""
    goes = plan.where(F.contains("fate", F.lit(" past "))).select("trace_id", "fate")
    return traces.where("not breached and not annotated").join(goes, "trace_id").select("trace_id", "fate")


def apply_plan(plan: DataFrame, traces: DataFrame) -> DataFrame:
    return traces.join(retired(plan, traces).select("trace_id"), "trace_id", "left_anti")


def clean(traces: DataFrame, now_us: int, keep_days: int | None = None, most: int | None = None, keep_breached: bool = False) -> DataFrame:
    """trace_id, why of runs to delete: older than so many days, then the oldest beyond the newest `most` that are left.
    Breached ones may be kept, and then don't count."""
    rows = traces.where("not breached") if keep_breached else traces
    old = F.lit(False) if keep_days is None else F.col("created_us") < now_us - keep_days * DAY_US
    out = rows.where(old).select("trace_id", F.lit("age").alias("why"))
    if most is None:
        return out
    # newest first, in one order over all rows: only ids and times are sorted
    rest = rows.where(~old).select("trace_id", F.row_number().over(W.orderBy(F.desc("created_us"), F.desc("trace_id"))).alias("n"))
    return out.unionByName(rest.where(F.col("n") > most).select("trace_id", F.lit("count").alias("why")))


# packs


def manifest(files: DataFrame) -> DataFrame:
    """name, bytes, sha256 of files (name, content)."""
    return files.select("name", F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def manifest_faults(files: DataFrame, listed: DataFrame) -> DataFrame:
    """name, fault: missing, extra or mismatch of files against a manifest; names that lead out of the folder escape."""
    now = manifest(files).select("name", F.col("sha256").alias("now"))
    both = listed.select("name", F.col("sha256").alias("was")).join(now, "name", "full_outer")
    out = F.when(F.col("name").rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"), "escapes").when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("now") != F.col("was"), "mismatch")
    return both.select("name", out.alias("fault")).where("fault is not null")


# the archive of posts


def posts(rows: DataFrame, kind: str | None = None, unverified_only: bool = False, since_us: int | None = None, contains: str | None = None, sender: str | None = None) -> DataFrame:
    """Posts (received_us, verified, kind, sender, payload) that pass all filters that are set."""
    out = rows
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if unverified_only:
        out = out.where(~F.coalesce("verified", F.lit(False)))
    if since_us is not None:
        out = out.where(F.col("received_us") >= since_us)
    if sender is not None:
        out = out.where(F.col("sender") == sender)
    return out if contains is None else out.where(F.contains(F.lower("payload"), F.lit(contains.lower())))


def last_posts(rows: DataFrame, limit: int = 20, **filters) -> DataFrame:
    """The last `limit` of them, by the place in the archive (row)."""
    return posts(rows, **filters).orderBy(F.desc("row")).limit(limit)


def post_stats(rows: DataFrame, **filters) -> DataFrame:
    """rows, verified, unverified, malformed, kinds, senders, first and last receipt. A post without a kind is malformed."""
    p = posts(rows, **filters)
    return p.agg(F.count("*").alias("rows"), F.count_if("verified").alias("verified"), F.count_if(~F.coalesce("verified", F.lit(False))).alias("unverified"), F.count_if(F.col("kind").isNull()).alias("malformed"), F.countDistinct("kind").alias("kinds"), F.countDistinct("sender").alias("senders"), F.min("received_us").alias("first_us"), F.max("received_us").alias("last_us"))


def shipments(rows: DataFrame, store: DataFrame) -> DataFrame:
    """trace_id, state of runs that came by post: conflict where payloads of one id differ; in_store; unverified where the
    first post of it isn't; else importable."""
    own = rows.where("kind = 'trace_ship' and trace_id is not null")
    each = own.groupBy("trace_id").agg(F.min_by("verified", "row").alias("verified"), (F.min("payload") != F.max("payload")).alias("conflict"))
    has = store.select("trace_id", F.lit(True).alias("has"))
    state = F.when(F.col("conflict"), "conflict").when(F.col("has"), "in_store").when(~F.col("verified"), "unverified").otherwise("importable")
    return each.join(has, "trace_id", "left").select("trace_id", state.alias("state"))


def limited(rows: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """Posts with `allowed`: whether fewer than `most` posts of the sender came in the time before, those refused included.
    What counts is how old the post `most` places back is. Each span of that time is judged by itself, with the last `most`
    posts of the span before, so that neither a frame nor a task grows with the posts of a sender."""
    span, at = seconds * 1_000_000, F.col("received_us")
    part = W.partitionBy("sender", "_span")
    posts = rows.withColumns({"_span": at - F.pmod(at, F.lit(span)), "_old": F.lit(False)})
    last = posts.select("sender", "received_us", "_span", F.row_number().over(part.orderBy(F.desc("received_us"))).alias("n")).where(F.col("n") <= most)
    before = last.where(at.isNotNull()).select("sender", "received_us", (F.col("_span") + span).alias("_span"), F.lit(True).alias("_old"))
    both = posts.unionByName(before, allowMissingColumns=True)
    back = both.withColumn("_back", F.lag(F.struct("received_us"), most).over(part.orderBy("received_us")))
    crowded = back.withColumn("_crowded", F.col("_back").isNotNull() & F.coalesce(at - F.col("_back.received_us") < span, F.lit(True)))
    # posts of one instant count for each other: they are judged as the last of them is
    judged = crowded.withColumn("allowed", ~F.max("_crowded").over(W.partitionBy("sender", "_span", "received_us")))
    return judged.where("not _old").drop("_span", "_old", "_back", "_crowded")


def ship_plan(traces: DataFrame, newest: int, size: int) -> DataFrame:
    """trace_id, batch, place: the newest so many runs, oldest first, in batches."""
    last = traces.orderBy(F.desc("created_us"), F.desc("trace_id")).limit(newest)
    n = F.row_number().over(W.orderBy("created_us", "trace_id")) - 1
    return last.select("trace_id", n.alias("n")).select("trace_id", F.floor(F.col("n") / size).cast("long").alias("batch"), (F.col("n") % size).cast("long").alias("place"))


def queue_after(queue: DataFrame, outcomes: DataFrame, store: DataFrame) -> DataFrame:
    """trace_id, url, attempts of a retry queue after a flush: what was delivered goes, and runs that are gone; what failed
    counts one attempt more, and comes in where it is new. outcomes: trace_id, url, ok."""
    both = queue.join(outcomes, ["trace_id", "url"], "full_outer").where("not coalesce(ok, false)")
    tried = F.coalesce("attempts", F.lit(0)) + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
    return both.join(store.select("trace_id"), "trace_id", "left_semi").select("trace_id", "url", tried.cast("long").alias("attempts"))


def match_rate(models: DataFrame, prices: dict[str, float]) -> DataFrame:
    """model, rate of each model: by its exact name, else in any case, else by what follows its last slash. The prices are
    a small table of the caller's."""
    for name, rate in prices.items():
        if isinstance(rate, bool) or not 0 <= float(rate) < float("inf"):
            raise ValueError(f"the rate of {name!r} is no finite number of 0 or more")
    spark = models.sparkSession
    table = spark.createDataFrame(sorted((k, k.lower(), float(v)) for k, v in prices.items()), "name string, low string, rate double")
    low = table.groupBy("low").agg(F.min_by("rate", "name").alias("rate"))
    exact = F.broadcast(table.select(F.col("name").alias("model"), F.col("rate").alias("r1")))
    cased = F.broadcast(low.select(F.col("low").alias("l1"), F.col("rate").alias("r2")))
    tail = F.broadcast(low.select(F.col("low").alias("l2"), F.col("rate").alias("r3")))
    rows = models.select("model").distinct().withColumns({"l1": F.lower("model"), "l2": F.lower(F.substring_index("model", "/", -1))})
    return rows.join(exact, "model", "left").join(cased, "l1", "left").join(tail, "l2", "left").select("model", F.coalesce("r1", "r2", "r3").alias("rate"))


def severity(column: Column) -> Column:
    return F.when(column == 0, "clean").when(column < 3, "suspicious").otherwise("malicious")
