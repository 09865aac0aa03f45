"""What would help: repaired runs, calibrated sets of modes, duplicate groups, merges and grades over two weeks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import attribution, detect, rollup
from .sequence import MATCH, _calls, similarity


def without_repeats(steps: DataFrame) -> DataFrame:
    """The steps less successful calls that were made before; places are counted anew."""
    good = (F.col("kind") == "tool_call") & F.col("error").isNull()
    nth = F.row_number().over(W.partitionBy("trace_id", "fingerprint", good).orderBy("step_index"))
    kept = steps.withColumn("nth", nth).where(~good | (F.col("nth") == 1)).drop("nth")
    return kept.withColumn("step_index", (F.row_number().over(W.partitionBy("trace_id").orderBy("step_index")) - 1).cast("long"))


def with_checks(steps: DataFrame) -> DataFrame:
    """The steps with a check after each change that none follows; places are counted anew."""
    w = W.partitionBy("trace_id").orderBy("step_index").rowsBetween(1, W.unboundedFollowing)
    bare = steps.withColumn("later", F.coalesce(F.max("is_verify").over(w), F.lit(False))).where("mutating and error is null and not later").drop("later")
    new = {"tool": F.concat(F.lit("verify_"), F.col("tool")), "fingerprint": F.concat(F.lit("tool_call:verify_"), F.col("tool"), F.lit(":"), F.col("args_canon")), "result": F.concat(F.lit("re-checked after "), F.col("tool"), F.lit(": state consistent")), "thought": F.lit(None).cast("string"), "mutating": F.lit(False), "is_verify": F.lit(True), "share_with": F.lit(None).cast("array<string>"), "agent": F.lit(None).cast("string")}
    checks = bare.withColumns({k: v for k, v in new.items() if k in steps.columns}).withColumn("half", F.lit(1))
    both = steps.withColumn("half", F.lit(0)).unionByName(checks)
    return both.withColumn("step_index", (F.row_number().over(W.partitionBy("trace_id").orderBy("step_index", "half")) - 1).cast("long")).drop("half")


def plan_repair(steps: DataFrame, traces: DataFrame) -> DataFrame:
    """trace_id, cleared, remaining: the modes of failed runs that dropping repeats and adding checks would clear, and the
    others. Both sides go through the rules once, all runs together."""
    failed = traces.where("success = false").select("trace_id")
    mine = steps.join(failed, "trace_id", "left_semi")
    mended = with_checks(without_repeats(mine))
    ends = mended.groupBy("trace_id").agg(F.count("*").alias("n_steps"), F.max_by("kind", "step_index").alias("last_kind"), F.max("step_index").alias("last_index"))
    after_traces = traces.drop("n_steps", "last_kind", "last_index").join(ends, "trace_id")
    before_traces = traces.join(failed, "trace_id", "left_semi")
    modes = lambda s, t, name: detect.run_rules(s, t).where("confidence >= 0.5").groupBy("trace_id").agg(F.collect_set("mode_id").alias(name))
    both = modes(mine, before_traces, "before").join(modes(mended, after_traces, "after"), "trace_id", "left").withColumn("after", F.coalesce("after", F.array().cast("array<string>")))
    return both.select("trace_id", F.array_join(F.sort_array(F.array_except("before", "after")), ",").alias("cleared"), F.array_join(F.sort_array(F.array_intersect("before", "after")), ",").alias("remaining"))


def softmax(scores: DataFrame, temperature: float) -> DataFrame:
    """scores with p: each run's scores as probabilities. scores: trace_id, mode_id, score."""
    w = W.partitionBy("trace_id")
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    return scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def fit_temperature(scores: DataFrame, gold: DataFrame, low: float = 0.5, high: float = 5.0, rounds: int = 40) -> float:
    """The temperature of the least mean negative log-likelihood of the true modes, by golden-section search. Each probe is one
    aggregate; the scores never come to the driver. gold: trace_id, mode_id."""
    rows = scores.join(gold.select("trace_id", F.col("mode_id").alias("gold")), "trace_id").cache()

    def loss(*at: float) -> list[float]:
        top = F.max("score").over(W.partitionBy("trace_id"))
        shifted = rows.withColumn("s", F.col("score") - top)
        terms = [(F.log(F.sum(F.exp(F.col("s") / t))) - F.coalesce(F.max(F.when(F.col("mode_id") == F.col("gold"), F.col("s"))) / t, F.lit(-27.6))).alias(f"t{i}") for i, t in enumerate(at)]
        return list(shifted.groupBy("trace_id").agg(*terms).agg(*(F.avg(f"t{i}") for i in range(len(at)))).first())

    phi, a, b = (math.sqrt(5) - 1) / 2, low, high
    for _ in range(rounds):
        c, d = b - phi * (b - a), a + phi * (b - a)
        lc, ld = loss(c, d)
        a, b = (a, d) if lc < ld else (c, b)
    rows.unpersist()
    return round((a + b) / 2, 4)


def conformal_threshold(probabilities: DataFrame, gold: DataFrame, alpha: float = 0.1) -> float:
    """The ceil((n + 1)(1 - alpha))-th least of 1 - p of the true modes."""
    true = gold.join(probabilities, ["trace_id", "mode_id"], "left").select((1 - F.coalesce("p", F.lit(0.0))).alias("x"))
    n = true.count()
    at = min(max(math.ceil((1 - alpha) * (n + 1)) - 1, 0), n - 1)
    by = true.groupBy("x").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    return by.where(F.col("upto") > at).agg(F.min("x")).first()[0]


def conformal_sets(probabilities: DataFrame, threshold: float) -> DataFrame:
    return probabilities.where(1 - F.col("p") <= threshold).groupBy("trace_id").agg(F.array_join(F.sort_array(F.collect_set("mode_id")), ",").alias("modes"))


def _errors(n: int, threshold: float) -> int:
    """How many edits two runs may be apart, of which one has n calls: each costs a half of a match at least."""
    return int(2 * MATCH / 2 * (1 - threshold) * (n / threshold) + 1e-9)


def _blocks(threshold: float):
    """Keys under which any two runs that are alike enough meet: runs of n calls are cut into one part more than the edits they
    may be apart, so that one part stands unchanged in the other run, near the same place."""

    def cuts(n: int, parts: int) -> list[int]:
        return [n * i // parts for i in range(parts + 1)]

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            out = []
            for node, ids in zip(table["node"], table["ids"]):
                n, keys = len(ids), set()
                for m in range(max(1, math.ceil(n * threshold - 1e-9)), int(n / threshold + 1e-9) + 1):
                    errors = min(_errors(m, threshold), m - 1)
                    at = cuts(m, errors + 1)
                    for i, (a, b) in enumerate(zip(at, at[1:])):
                        for shift in range(-errors, errors + 1) if m != n or errors else (0,):
                            if 0 <= a + shift and b + shift <= n:
                                digest = hashlib.blake2b("\x00".join(ids[a + shift : b + shift]).encode(), digest_size=12).hexdigest()
                                keys.add((f"{m}:{i}:{digest}", m == n and shift == 0))
                out += [(node, k, own) for k, own in keys]
            yield pd.DataFrame(out, columns=["node", "key", "own"])

    return run


def duplicate_groups(steps: DataFrame, threshold: float = 0.95, most: int | None = None) -> DataFrame:
    """trace_id, representative, similarity: each run in the order of ids with the first representative it is alike to, itself
    where there is none. most: only so many first ids, as an option of the caller's.

    Runs of equal calls are one. Runs that may be alike meet under a block's key; pairs that are alike make a graph, and the
    representatives are found in rounds: who has no representative or open run before it among its neighbours is one."""
    rows = _calls(steps)
    if most is not None:
        rows = rows.orderBy("trace_id").limit(most)
    same = F.when(F.size("ids") > 0, F.md5(F.array_join("ids", "\x00"))).otherwise(F.md5(F.concat(F.lit("-"), "outline")))
    rows = rows.withColumn("same", same).withColumn("node", F.min("trace_id").over(W.partitionBy("same"))).persist()
    heads = rows.where("trace_id = node and size(ids) > 0").select("node", "ids", "shapes")
    keys = heads.select("node", "ids").mapInPandas(_blocks(threshold), "node string, key string, own boolean").persist()
    mine, other = keys.where("own").select("key", F.col("node").alias("x")), keys.select("key", F.col("node").alias("y"))
    pairs = mine.join(other, "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = (heads.select(F.col("node").alias(x), F.col("ids").alias(f"{x}_ids"), F.col("shapes").alias(f"{x}_shapes")) for x in "ab")

    def judge(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            score = [similarity(list(zip(r.a_ids, r.a_shapes)), list(zip(r.b_ids, r.b_shapes))) for r in t.itertuples()]
            yield pd.DataFrame({"a": t["a"], "b": t["b"], "s": score})

    edges = pairs.join(left, "a").join(right, "b").mapInPandas(judge, "a string, b string, s double").where(F.col("s") >= threshold).persist()
    # state: null open, true a representative, false not
    state = heads.select("node", F.lit(None).cast("boolean").alias("head"))
    while True:
        before = edges.join(state.select(F.col("node").alias("a"), "head"), "a").groupBy(F.col("b").alias("node")).agg(F.max(F.coalesce("head", F.lit(False))).alias("taken"), F.max(F.col("head").isNull()).alias("waits"))
        now = F.when(F.col("head").isNotNull(), F.col("head")).when(F.col("taken"), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = state.join(before, "node", "left").select("node", now.alias("head")).checkpoint() if state.sparkSession.sparkContext.getCheckpointDir() else state.join(before, "node", "left").select("node", now.alias("head")).persist()
        if not state.where("head is null").limit(1).count():
            break
    first = edges.join(state.where("head").select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min_by(F.struct(F.col("a").alias("representative"), F.col("s").alias("similarity")), "a").alias("r"))
    found = state.where("not head").join(first, "node").select("node", "r.*")
    out = rows.join(found, "node", "left").select("trace_id", F.coalesce("representative", "node").alias("representative"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    return out


def merge(source: DataFrame, target: DataFrame) -> DataFrame:
    """trace_id, status of a merge of two stores (trace_id, content): new, same, conflict, kept."""
    s, t = source.select("trace_id", F.col("content").alias("s")), target.select("trace_id", F.col("content").alias("t"))
    status = F.when(F.col("t").isNull(), "new").when(F.col("s").isNull(), "kept").when(F.col("s") == F.col("t"), "same").otherwise("conflict")
    return s.join(t, "trace_id", "full_outer").select("trace_id", status.alias("status"))


def grade_trend(steps: DataFrame, traces: DataFrame, by: str, now_us: int) -> DataFrame:
    """subject, now, prev, direction: letters of the last seven days and of the seven before."""
    week = 7 * rollup.DAY_US

    def letters(low: int, high: int, name: str) -> DataFrame:
        t = traces.where((F.col("created_us") > low) & (F.col("created_us") <= high))
        return rollup.grades(rollup.scorecard(steps.join(t.select("trace_id"), "trace_id", "left_semi"), t, by)).select("subject", F.col("grade").alias(name))

    both = letters(now_us - week, now_us, "now").join(letters(now_us - 2 * week, now_us - week, "prev"), "subject", "full_outer")
    at = lambda c: F.expr(f"instr('FDCBA', {c})")
    move: Column = F.when(F.col("now").isNull(), "gone").when(F.col("prev").isNull(), "new").when((F.col("now") == "n/a") | (F.col("prev") == "n/a"), "thin").when(at("now") > at("prev"), "improved").when(at("now") < at("prev"), "slipped").otherwise("flat")
    return both.withColumn("direction", move)



def counterfactual(steps: DataFrame, traces: DataFrame) -> DataFrame:
    """trace_id, step_index, mode_id, eliminated, was_primary for each detection of a run: whether the mode is gone once its
    step is taken out and the rules are run anew. All such runs go through the rules together, once."""
    # a row for each run, so that what the rules found is worked out once for all that follows
    hits = detect.run_rules(steps, traces).groupBy("trace_id").agg(F.collect_list(F.struct("mode_id", "step_index", "confidence")).alias("hits"))
    found = hits.select("trace_id", F.explode("hits").alias("x")).select("trace_id", "x.mode_id", "x.step_index", "x.confidence")
    primary = attribution.verdicts(found, traces).select("trace_id", "primary_mode")
    cases = found.where(F.col("confidence") >= attribution.FLOOR).select("trace_id", F.col("step_index").alias("cut"), "mode_id").distinct()
    cuts = cases.groupBy("trace_id", "cut").agg(F.collect_set("mode_id").alias("modes"))
    case, left = ["trace_id", "cut"], F.col("step_index") != F.col("cut")
    # what a step says by itself is the same in all cases; its place is one less behind the step that is out
    placed = lambda rows: rows.withColumn("pos", (F.row_number().over(W.partitionBy("trace_id").orderBy("step_index")) - 1).cast("long"))
    without = lambda rows, cuts: rows.join(cuts, "trace_id").where(left).withColumn("step_index", F.col("pos") - (F.col("step_index") > F.col("cut")).cast("long"))
    rules = detect._judged(without(placed(detect._facts(steps, traces, "kind")), cuts.select(*case)), case, counted=True)
    # lost references and cycles are looked for only where they were found
    of = lambda mode: cuts.where(F.array_contains("modes", mode)).select(*case)
    entities = detect._entities(placed(steps.select("trace_id", "step_index", "kind", "result", "thought")), "pos")
    lost = detect._lost(without(entities, of("FM-1.4")), case).select(*case, F.lit("FM-1.4").alias("mode_id"))
    series = detect._series(steps).join(of("FM-1.3"), "trace_id").withColumn("c", F.filter("c", lambda x: x["step_index"] != F.col("cut"))).where(F.size("c") >= detect.CYCLE_CALLS)
    cycles = detect._cycles(series, {"trace_id": "string", "cut": "long"})
    after = rules.where(F.col("confidence") >= attribution.FLOOR).select(*case, "mode_id").unionByName(lost).unionByName(cycles.select(*case, "mode_id"))
    out = cases.join(after.distinct().withColumn("still", F.lit(True)), [*case, "mode_id"], "left").join(primary, "trace_id")
    return out.select("trace_id", F.col("cut").alias("step_index"), "mode_id", F.col("still").isNull().alias("eliminated"), (F.col("mode_id") == F.col("primary_mode")).alias("was_primary"))


def distributed_modes(interventions: DataFrame) -> DataFrame:
    """trace_id, mode_id of modes that no single step's removal clears."""
    return interventions.groupBy("trace_id", "mode_id").agg(F.max("eliminated").alias("killed")).where("not killed").select("trace_id", "mode_id")
