"""Operators over one run's steps in order: alignment, edit scripts, context budgets, hash chains, risk over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import shape

MATCH, SUBSTITUTE, GAP = 2.0, 1.0, -1.0


def _calls(steps: DataFrame) -> DataFrame:
    """trace_id, ids, shapes, outline: each call as itself and as its tool with its arguments' names, in order; the task and
    the last response."""
    call = F.when(F.col("kind") == "tool_call", F.struct("step_index", F.concat_ws(":", "tool", "args_canon").alias("id"), shape().alias("shape")))
    column = lambda c: F.coalesce(c, F.lit("")) if c in steps.columns else F.lit("")
    answer = F.when(F.col("kind") == "response", F.col("step_index"))
    said = F.max_by(F.when(answer.isNotNull(), column("result")), answer)
    rows = steps.groupBy("trace_id").agg(F.sort_array(F.collect_list(call)).alias("c"), F.concat_ws("\x00", F.first(column("task")), F.coalesce(said, F.lit(""))).alias("outline"))
    return rows.select("trace_id", F.col("c.id").alias("ids"), F.col("c.shape").alias("shapes"), "outline")


def alignment(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[list[float]]:
    """The table of global alignment scores of two sequences of (identity, shape)."""
    table = [[GAP * j for j in range(len(b) + 1)]]
    for i, (ida, sha) in enumerate(a, 1):
        row, last = [GAP * i], table[-1]
        for j, (idb, shb) in enumerate(b, 1):
            row.append(max(last[j - 1] + (MATCH if ida == idb else SUBSTITUTE if sha == shb else 0.0), last[j] + GAP, row[j - 1] + GAP))
        table.append(row)
    return table


def similarity(a: list[tuple[str, str]], b: list[tuple[str, str]], same: bool = False) -> float:
    """same: whether two runs have the same task and answer, which decides where neither has calls."""
    if not a or not b:
        return float(same and not a and not b)
    return max(0.0, min(1.0, alignment(a, b)[-1][-1] / (MATCH * max(len(a), len(b)))))


def most_similar(steps: DataFrame, target: str, top: int = 5) -> DataFrame:
    """trace_id, similarity of the runs whose calls align best with the target's, ties by id. Runs are compared where they lie;
    only the target's calls are sent to them."""
    rows = _calls(steps)
    own = rows.where(F.col("trace_id") == target).first()
    goal = list(zip(own.ids, own.shapes)) if own else []
    outline = own.outline if own else None

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"trace_id": part["trace_id"], "similarity": [similarity(goal, list(zip(i, s)), o == outline) for i, s, o in zip(part["ids"], part["shapes"], part["outline"])]})

    # no more can match than the shorter run has calls
    bound = F.least(F.size("ids"), F.lit(len(goal))) / F.greatest(F.size("ids"), F.lit(len(goal)), F.lit(1))
    scored = rows.where((F.col("trace_id") != target) & ((bound > 0) | (F.size("ids") == 0) & F.lit(not goal))).mapInPandas(score, "trace_id string, similarity double")
    return scored.orderBy(F.desc("similarity"), "trace_id").limit(top)


def edit_script(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[str, int | None, int | None, float]]:
    """(operation, place in a, place in b, likeness): equal, mutated, deleted, inserted; where scores tie, a step of both goes
    before a deletion, and that before an insertion."""
    table, out, i, j = alignment(a, b), [], len(a), len(b)
    while i or j:
        if i and j:
            same, shape = a[i - 1][0] == b[j - 1][0], a[i - 1][1] == b[j - 1][1]
            if table[i][j] == table[i - 1][j - 1] + (MATCH if same else SUBSTITUTE if shape else 0.0):
                out.append(("equal" if same else "mutated", i - 1, j - 1, 1.0 if same else round(SequenceMatcher(None, a[i - 1][0], b[j - 1][0]).ratio(), 3)))
                i -= 1
                j -= 1
                continue
        if i and table[i][j] == table[i - 1][j] + GAP:
            out.append(("deleted", i - 1, None, 0.0))
            i -= 1
        else:
            out.append(("inserted", None, j - 1, 0.0))
            j -= 1
    return out[::-1]


def diff(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, ordinal, operation, at_a, at_b, likeness for each pair of runs (a, b)."""
    c = _calls(steps)
    left, right = (c.select(F.col("trace_id").alias(x), F.col("ids").alias(f"{x}_ids"), F.col("shapes").alias(f"{x}_shapes")) for x in "ab")

    def script(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r.a, r.b, n, *e) for r in part.itertuples() for n, e in enumerate(edit_script(list(zip(r.a_ids, r.a_shapes)), list(zip(r.b_ids, r.b_shapes))))]
            out = pd.DataFrame(rows, columns=["a", "b", "ordinal", "operation", "at_a", "at_b", "likeness"])
            yield out.astype({"ordinal": "int64", "at_a": "Int64", "at_b": "Int64", "likeness": "float64"})

    return pairs.join(left, "a").join(right, "b").mapInPandas(script, "a string, b string, ordinal long, operation string, at_a long, at_b long, likeness double")


def first_fault(script: DataFrame, floor: float = 0.8) -> DataFrame:
    """a, b, ordinal of the first entry that isn't equal, mutations of at least the floor's likeness left out."""
    rows = script.where((F.col("operation") != "equal") & ~((F.col("operation") == "mutated") & (F.col("likeness") >= floor)))
    return rows.groupBy("a", "b").agg(F.min("ordinal").alias("ordinal"))


def token_estimate(text: str) -> int:
    return max(1, len(text) // 4)


def simulate(task: str, results: list[tuple[str, str]], budget: int) -> tuple[int, int, int]:
    """Tokens in the window at the end, evictions, and results still in it: results are added in order, and the oldest go
    while the window is over its budget; the task stays."""
    window: dict[str, int] = {}
    used, evicted = token_estimate(task) if task else 0, 0
    for key, text in results:
        used += token_estimate(text) - window.get(key, 0)
        window[key] = token_estimate(text)
        while used > budget and window:
            used -= window.pop(next(iter(window)))
            evicted += 1
    return used, evicted, len(window)


def context_forecast(steps: DataFrame, budgets: list[int]) -> DataFrame:
    """trace_id, budget, used, evicted, kept, recall (share of results still there at the end) under each budget."""
    rows = steps.groupBy("trace_id").agg(F.first("task").alias("task"), F.sort_array(F.collect_list(F.when((F.col("kind") == "tool_call") & (F.col("result") != ""), F.struct("step_index", F.concat_ws("#", "tool", F.col("step_index").cast("string")).alias("key"), "result")))).alias("r"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                given = [(x["key"], x["result"]) for x in r.r]
                for b in budgets:
                    used, evicted, kept = simulate(r.task, given, b)
                    out.append((r.trace_id, b, used, evicted, kept, kept / len(given) if given else 1.0))
            yield pd.DataFrame(out, columns=["trace_id", "budget", "used", "evicted", "kept", "recall"])

    return rows.mapInPandas(run, "trace_id string, budget long, used long, evicted long, kept long, recall double")


def least_budget(forecasts: DataFrame, recall: float = 1.0) -> DataFrame:
    """trace_id, budget: the least of the budgets tried under which a run keeps so much."""
    return forecasts.where(F.col("recall") >= recall).groupBy("trace_id").agg(F.min("budget").alias("budget"))


SIGNED = ("kind", "tool", "args_canon", "result", "thought", "tokens", "latency_ms", "error", "agent")


def content(steps: DataFrame, fields: tuple[str, ...] = SIGNED) -> Column:
    """Fields as one text that no other fields give: each with its length before it, or - where it is null or isn't there."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*(F.coalesce(F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) if c in steps.columns else F.lit("-") for c in fields))


def chain(steps: DataFrame, seed: Column, mac: Callable[[Column], Column] | None = None) -> DataFrame:
    """trace_id, hashes: each step's hash over the one before it and all of the step's own content; the first over the seed.
    mac: a keyed hash in place of the plain one."""
    mac = mac or (lambda m: F.sha2(m, 256))
    rows = steps.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("step_index", content(steps).alias("own")))).getField("own").alias("own"), F.first(seed).alias("seed"))
    start = F.array(F.sha2("seed", 256))
    fold = F.aggregate("own", start, lambda acc, x: F.concat(acc, F.array(mac(F.concat(F.element_at(acc, -1), x)))))
    return rows.select("trace_id", F.slice(fold, 2, F.greatest(F.size("own"), F.lit(1))).alias("hashes"))


def tampered(signed: DataFrame, steps: DataFrame, seed: Column, mac: Callable[[Column], Column] | None = None) -> DataFrame:
    """trace_id, verdict (intact, tampered, unsigned), step: where the stored hashes first differ from those of the steps.
    signed: trace_id, hashes."""
    now = chain(steps, seed, mac).withColumnRenamed("hashes", "now").join(signed, "trace_id", "left")
    n = F.greatest(F.size("now"), F.size("hashes"))
    bad = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("now", i).eqNullSafe(F.get("hashes", i)))
    verdict = F.when(F.col("hashes").isNull(), "unsigned").when(F.size(bad) == 0, "intact").otherwise("tampered")
    return now.select("trace_id", verdict.alias("verdict"), F.when(verdict == "tampered", F.get(bad, F.lit(0))).cast("long").alias("step"))


def ledger_breaks(ledger: DataFrame) -> DataFrame:
    """seq of entries whose chain isn't the hash of the chain before it and their own content. ledger: seq, trace_id, root, chain."""
    before = F.coalesce(F.lag("chain").over(W.orderBy("seq")), F.lit(""))
    return ledger.withColumn("want", F.sha2(F.concat(before, F.concat_ws("|", F.col("seq").cast("string"), "trace_id", "root")), 256)).where("want <> chain").select("seq")


def with_precursor(rows: DataFrame, steps: DataFrame, model: DataFrame) -> DataFrame:
    """risk() with `precursor`, and `risk` raised by half of it where it is above 0: how much likelier than even the calls so
    far make a failure, from -1 to 1. Of each length the run of calls that the model saw most often (the first of such)
    votes, as in stats.precursor_score. model: n, gram, occurrences, p_fail."""
    from .stats import ngrams

    by = W.partitionBy("trace_id").orderBy("step_index")
    place = steps.where("kind = 'tool_call'").select("trace_id", "step_index", F.row_number().over(by).alias("pos"))
    # a run of n calls that begins at a place is whole n - 1 calls later
    grams = ngrams(steps).join(model.select("n", "gram", "occurrences", "p_fail"), ["n", "gram"]).withColumn("at", F.col("pos") + F.col("n") - 1)
    best = F.max(F.struct("occurrences", -F.col("pos"), "p_fail")).over(W.partitionBy("trace_id", "n").orderBy("at"))
    weight = F.least("b.occurrences", F.lit(20)) * F.col("n")
    odds = grams.withColumn("b", best).groupBy("trace_id", F.col("at").alias("pos")).agg((F.sum(weight * F.log(F.col("b.p_fail") / (1 - F.col("b.p_fail")))) / F.sum(weight)).alias("z"))
    at = odds.join(place, ["trace_id", "pos"]).select("trace_id", "step_index", (2 / (1 + F.exp(-F.col("z"))) - 1).alias("now"))
    out = rows.join(at, ["trace_id", "step_index"], "left").withColumn("precursor", F.coalesce(F.last("now", ignorenulls=True).over(by), F.lit(0.0))).drop("now")
    return out.withColumn("risk", F.least(F.lit(1.0), F.col("risk") + 0.5 * F.greatest(F.lit(0.0), F.col("precursor"))))


def risk(steps: DataFrame) -> DataFrame:
    """trace_id, step_index, repetition, debt, risk after each step: the same step again within six, and changes not yet
    verified (never below none: the running sum above its own lowest point)."""
    w = W.partitionBy("trace_id").orderBy("step_index")
    recent = F.collect_list("fingerprint").over(w.rowsBetween(-5, 0))
    again = F.size(F.filter(recent, lambda x: x == F.col("fingerprint")))
    move = F.when((F.col("kind") == "tool_call") & F.col("mutating"), 1).when(F.col("is_verify"), -1).otherwise(0)
    rows = steps.withColumns({"again": again, "sum": F.sum(move).over(w)})
    rows = rows.withColumn("open", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w)))
    rows = rows.withColumns({"repetition": F.least(F.lit(1.0), (F.col("again") - 1) / 2), "debt": F.least(F.lit(1.0), F.col("open") / 2)})
    return rows.select("trace_id", "step_index", "repetition", "debt", (0.3 * F.col("repetition") + 0.2 * F.col("debt")).alias("risk"))


LEVELS = [("critical", 0.8), ("elevated", 0.55), ("watch", 0.3)]


def level(last: str, now: float, slack: float = 0.1) -> str:
    """The level of a risk, given the level before: a level is left only below its threshold less the slack."""
    if last == "critical" and now >= 0.8 - slack:
        return "critical"
    if last in ("critical", "elevated") and now >= 0.55 - slack:
        return "elevated"
    if last == "watch" and now >= 0.3 - slack:
        return "watch"
    return next((name for name, at in LEVELS if now >= at), "nominal")


def one_liners(steps: DataFrame, width: int = 72) -> DataFrame:
    """trace_id, step_index, line: each step as #place [kind] head: text, the text cut with dots."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    text = F.trim(F.regexp_replace(F.coalesce(some("error"), some("result"), "thought", F.lit("")), r"\s+", " "))
    cut = F.when(F.char_length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
    return steps.select("trace_id", "step_index", F.concat(F.lit("#"), F.col("step_index").cast("string"), F.lit(" ["), "kind", F.lit("] "), F.coalesce("tool", "kind"), F.lit(": "), cut).alias("line"))


def compacted(steps: DataFrame, most: int = 220) -> DataFrame:
    """What a judge is shown of each step: kind, tool, and the beginnings of its outcome and thought."""
    outcome = F.coalesce(F.when(F.col("error") != "", F.col("error")), "result", F.lit(""))
    thought = F.substring(F.coalesce("thought", F.lit("")), 1, most)
    return steps.select("trace_id", "step_index", "kind", "tool", F.substring(outcome, 1, most).alias("result"), F.when(thought != "", thought).alias("thought"))


def budget_curve(forecasts: DataFrame) -> DataFrame:
    """budget, recall (mean), evicted, whole (runs that keep everything)."""
    return forecasts.groupBy("budget").agg(F.round(F.avg("recall"), 9).alias("recall"), F.sum("evicted").alias("evicted"), F.count_if(F.col("recall") >= 1).alias("whole"))


def searched_budget(steps: DataFrame, recall: float, most: int) -> DataFrame:
    """trace_id, budget: the least budget up to `most` under which a run keeps so much, by bisection: what is kept never falls
    as the budget grows. Runs that keep less under the greatest have no row."""
    rows = steps.groupBy("trace_id").agg(F.first("task").alias("task"), F.sort_array(F.collect_list(F.when((F.col("kind") == "tool_call") & (F.col("result") != ""), F.struct("step_index", F.concat_ws("#", "tool", F.col("step_index").cast("string")).alias("key"), "result")))).alias("r"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                given = [(x["key"], x["result"]) for x in r.r]
                enough = lambda b: (simulate(r.task, given, b)[2] / len(given) if given else 1.0) >= recall  # noqa: E731, B023
                low, high = 1, most
                if not enough(high):
                    continue
                while low < high:
                    middle = (low + high) // 2
                    low, high = (low, middle) if enough(middle) else (middle + 1, high)
                out.append((r.trace_id, low))
            yield pd.DataFrame(out, columns=["trace_id", "budget"]).astype({"budget": "int64"})

    return rows.mapInPandas(run, "trace_id string, budget long")


def replay_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """trace_id, now_matches, now_diverges, rate_a, rate_b of two replays, step by step. a, b: trace_id, step_index, match."""
    both = a.select("trace_id", "step_index", F.col("match").alias("x")).join(b.select("trace_id", "step_index", F.col("match").alias("y")), ["trace_id", "step_index"])
    return both.groupBy("trace_id").agg(F.count_if(F.expr("y and not x")).alias("now_matches"), F.count_if(F.expr("x and not y")).alias("now_diverges"), F.avg(F.col("x").cast("int")).alias("rate_a"), F.avg(F.col("y").cast("int")).alias("rate_b"))
