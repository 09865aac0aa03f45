"""Runs as they arrive: a tail of new runs, and the risk of runs in flight with state kept for each."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequence import level
from ..operators.stats import shape
from ..sources import records


def arrivals(spark: SparkSession, directory: str, remember: str = "30 days") -> DataFrame:
    """A stream of the runs in a directory's JSON lines; an id that came before is left out. Ids are remembered for so long
    after they came, so that what is kept doesn't grow for ever."""
    rows = spark.readStream.format("text").load(directory).where(F.trim("value") != "").select(F.col("value").alias("raw"), F.try_parse_json("value").alias("v"))
    runs = records.native(rows).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", remember)
    return runs.dropDuplicatesWithinWatermark(["trace_id"]).drop("arrived")


def tail(spark: SparkSession, directory: str, checkpoint: str, announce: Callable[[DataFrame, int], None], once: bool = True):
    """Hands each batch of new runs to `announce`. once: what is there, then an end; else on and on. The checkpoint remembers
    files and ids, so that a restart announces nothing twice."""
    writer = arrivals(spark, directory).writeStream.foreachBatch(announce).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


OUT = "trace_id string, step_index long, risk double, level string, escalated boolean"
STATE = "recent array<string>, open long, level string, calls array<string>, seen array<double>, fails array<double>"
#: A run without a step for so long is forgotten.
IDLE_MS = 24 * 3_600_000


def _precursor(calls: list[str], seen: list[float], fails: list[float], model: dict[str, tuple[int, float]]) -> float:
    """How much likelier than even the calls so far make a failure. Of each length the run of calls that the model saw most
    often, the first of such, is kept (seen: how often; fails: its share)."""
    total = weights = 0.0
    for n in (1, 2, 3):
        gram = "|".join(calls[-n:])
        if len(calls) >= n and model.get(gram, (0, 0.0))[0] > seen[n - 1]:
            seen[n - 1], fails[n - 1] = model[gram]
        if seen[n - 1]:
            weight = min(seen[n - 1], 20) * n
            total += weight * math.log(fails[n - 1] / (1 - fails[n - 1]))
            weights += weight
    return 2 / (1 + math.exp(-total / weights)) - 1 if weights else 0.0


def _follow(model: dict[str, tuple[int, float]], idle_ms: int | None):
    """The six last steps, open changes, the last level, the last three calls and what they say of failure are all that is
    kept of a run."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, open_, last, calls, seen, fails = state.get if state.exists else ([], 0, "nominal", [], [0.0] * 3, [0.0] * 3)
        recent, calls, seen, fails, out = list(recent), list(calls), list(seen), list(fails), []
        rows = pd.concat(list(parts))
        for r in rows.sort_values("step_index").itertuples():
            recent = [*recent, r.fingerprint][-6:]
            if r.kind == "tool_call":
                calls = [*calls, f"tool_call:{r.shape}"][-3:]
            if r.kind == "tool_call" and r.mutating:
                open_ += 1
            elif r.is_verify:
                open_ = max(0, open_ - 1)
            risk = 0.3 * min(1.0, (recent.count(r.fingerprint) - 1) / 2) + 0.2 * min(1.0, open_ / 2)
            risk = min(1.0, risk + 0.5 * max(0.0, _precursor(calls, seen, fails, model)))
            now = level(last, risk)
            out.append((key[0], r.step_index, risk, now, now in ("elevated", "critical") and now != last))
            last = now
        state.update((recent, int(open_), last, calls, seen, fails))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["trace_id", "step_index", "risk", "level", "escalated"])

    return run


def risk_monitor(steps: DataFrame, model: dict[str, tuple[int, float]] | None = None, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """A stream of steps (trace_id, step_index, kind, fingerprint, mutating, is_verify; with a model also tool, args_canon) as one
    of risks. model: of the runs of calls to watch for, their occurrences and share of failures, as stats.precursors() gives
    them; the caller bounds it, by occurrences, to what every worker may hold. idle_ms: after how long without a step a run is
    forgotten; None for streams that end when all is read, which would else wait for that."""
    keep = steps.select("trace_id", "step_index", "kind", "fingerprint", "mutating", "is_verify", (shape() if model else F.lit("")).alias("shape"))
    return keep.groupBy("trace_id").applyInPandasWithState(_follow(model or {}, idle_ms), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def inbox(spark: SparkSession, directory: str, window: str = "5 minutes") -> DataFrame:
    """A stream of verified posts, each signature once within the window. Lines: received_at, verified, kind, signature, payload."""
    schema = "received_at double, verified boolean, kind string, signature string, payload string"
    rows = spark.readStream.schema(schema).json(directory).withColumn("at", F.timestamp_micros((F.col("received_at") * 1e6).cast("long")))
    return rows.where("verified").withWatermark("at", window).dropDuplicatesWithinWatermark(["signature"])


def census(rows: DataFrame) -> DataFrame:
    """kind, n, verified, last of an archive's posts."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"), F.max("received_at").alias("last"))


def on_batch(keep: list[Any]) -> Callable[[DataFrame, int], None]:
    """For tests and notebooks: gathers ids of the announced runs, oldest first."""
    return lambda df, _: keep.extend(r.trace_id for r in df.orderBy("created_at", "trace_id").select("trace_id").collect())
