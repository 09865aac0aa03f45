"""Stores, digests, trust, what-ifs and duplicate groups, against plain versions and hand-made runs."""

import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import dataset, detect, digest, repair, sequence, store, trust
from spindrift.sources import adapters, records


def test_duplicate_groups_are_those_of_a_scan(spark):
    r = random.Random(4)
    bases = [[(f"t{r.randint(0, 5)}", r.randint(0, 3)) for _ in range(n)] for n in (0, 1, 4, 12, 25, 40, 41, 60)]
    runs = {}
    for i in range(90):
        calls = list(r.choice(bases))
        for _ in range(r.randint(0, 3)):
            if calls:
                k = r.randrange(len(calls))
                calls[k : k + 1] = r.choice([[], [calls[k], ("t9", 9)], [(calls[k][0], 7)], [("t8", 8)]])
        runs[f"r{i:03d}"] = calls
    rows = [(t, k, "tool_call", c, json.dumps({"a": v}), "task", None) for t, calls in runs.items() for k, (c, v) in enumerate(calls)]
    rows += [(t, 99, "response", None, "{}", "task", "done") for t in runs]
    steps = spark.createDataFrame(rows, "trace_id string, step_index long, kind string, tool string, args_canon string, task string, result string")
    pairs = {t: [(f"{c}:{json.dumps({'a': v})}", c + " {a}") for c, v in calls] for t, calls in runs.items()}
    heads, want = [], {}
    for t in sorted(pairs):
        want[t] = next(((h, s) for h in heads if (s := sequence.similarity(pairs[h], pairs[t], True)) >= 0.95), None) or (heads.append(t) or (t, 1.0))
    got = {x.trace_id: (x.representative, x.similarity) for x in repair.duplicate_groups(steps).collect()}
    assert got == want
    assert 1 < len(heads) < len(runs)


def test_hmac(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        got = spark.createDataFrame([("été 漢",), ("",)], "m string").select("m", trust.hmac(key, F.col("m")).alias("h")).collect()
        assert all(x.h == hmac.new(key, x.m.encode(), hashlib.sha256).hexdigest() for x in got)


def test_times_and_ids():
    assert store.since("1.5d", 200_000.0) == 200_000 - 129_600 and store.since("17", 0.0) == 17.0
    for text in ("nan", "1x", ""):
        with pytest.raises(ValueError):
            store.since(text, 0.0)


def test_unsafe_ids_are_refused(spark):
    t = spark.createDataFrame([("a",)], "trace_id string")
    assert store.lookup(t, "a").count() == 1
    for name in ("../a", "a b", ""):
        with pytest.raises(ValueError):
            store.lookup(t, name)


def run(id, *steps, success=True, **meta):
    return {"id": id, "task": "book a flight", "created_at": 5.0, "model": "m", "success": success, "meta": meta, "steps": list(steps)}


def call(tool, agent=None, result="ok", **meta):
    return {"kind": "tool_call", "tool": tool, "args": {"q": 1}, "result": result, "agent": agent, "meta": meta}


def from_records(spark, tmp_path, *runs):
    """Steps and traces of recorded runs, as the rules read them."""
    (tmp_path / "runs.jsonl").write_text("\n".join(map(json.dumps, runs)))
    return records.steps_and_traces(records.read(spark, str(tmp_path / "runs.jsonl")))


def test_rules_on_records(spark, tmp_path):
    s, t = from_records(
        spark,
        tmp_path,
        run("role", call("place_order", "a1"), {"kind": "response", "result": "done"}, role_tools={"browser": ["get_item"]}, agents={"a1": "browser"}),
        run("role_ok", call("get_item", "a1"), call("place_order", "a2"), role_tools={"browser": ["get_item"]}, agents={"a1": "browser"}),
        run("forbidden", call("x"), call("drop"), forbidden_tools=["wipe", "drop"]),
        run("ambiguous", call("change", mutating=True), ambiguous=True),
        run("early", {"kind": "response", "result": "no"}, success=False),
        run("share", call("find", "a1", share_with=["a2", "a3"]), call("get", "a3")),
        run("unverified", call("book_flight", mutating=True), {"kind": "response", "result": "booked"}),
        run("verified", call("book_flight", mutating=True), call("get_booking", result="there", verify=True)),
        run("limit", *(call(f"t{i}") for i in range(4)), step_limit=4),
        run("ack", {"kind": "message", "meta": {"from_agent": "a1", "to_agent": "a2", "requires_ack": True}}, call("x", "a1")),
    )
    got = {(r.trace_id, r.rule) for r in detect.run_rules(s, t).collect()}
    want = {("role", "role"), ("forbidden", "forbidden"), ("ambiguous", "clarify"), ("early", "premature"), ("share", "withhold"), ("unverified", "missing_verify"), ("limit", "long_loop"), ("ack", "ignored")}
    seen = {x for x in got if x[1] in {r for _, r in want}}
    assert seen - {("ambiguous", "missing_verify")} == want


def test_counterfactual(spark, tmp_path):
    """Of two changes without a check, neither's removal alone clears the mode; the forbidden call's does."""
    s, t = from_records(spark, tmp_path, run("a", call("book", mutating=True), call("pay", mutating=True), call("wipe"), success=False, forbidden_tools=["wipe"]))
    got = {(r.step_index, r.mode_id): r.eliminated for r in repair.counterfactual(s, t).collect()}
    assert got[2, "FM-1.1"] and not got[0, "FM-3.2"]
    assert {r.mode_id for r in repair.distributed_modes(repair.counterfactual(s, t)).collect()} >= {"FM-3.2"}


def test_searched_budget(spark):
    s = spark.createDataFrame([("t", i, "tool_call", f"tool{i}", "x" * 40, "go") for i in range(6)], "trace_id string, step_index long, kind string, tool string, result string, task string")
    assert sequence.searched_budget(s, 0.5, 100).first().budget == 31
    assert sequence.searched_budget(s, 1.0, 40).count() == 0


def test_sparkline_and_verdicts(spark):
    rows = spark.createDataFrame([("a", f"d{i}", v) for i, v in enumerate((0, 7, 3))] + [("b", "d0", 5), ("b", "d1", 5)], "k string, day string, v long")
    assert {r.k: r.line for r in digest.sparkline(rows, "k", "v").collect()} == {"a": "▁█▄", "b": "▅▅"}
    assert dataset.evaluate_multi(spark.createDataFrame([], "trace_id string, predicted array<string>, gold array<string>"))[0].count() == 0


def test_grade_trend(spark, tmp_path):
    day, now = 86_400, 100 * 86_400
    runs = []
    for who, then, ok in (("a", 10, False), ("a", 3, True), ("b", 2, True), ("c", 9, True), ("d", 12, True), ("d", 4, False), ("e", 11, True), ("e", 1, True)):
        for i in range(2):
            step = {**call("search", who), "error": None if ok else "boom"}
            runs.append({**run(f"{who}{then}{i}", step, success=ok), "created_at": now - then * day})
    runs.append({**run("f1", call("search", "f")), "created_at": now - day})
    s, t = from_records(spark, tmp_path, *runs)
    got = {r.subject: r.direction for r in repair.grade_trend(s, t, "agent", now * 1_000_000).collect()}
    assert got == {"a": "improved", "b": "new", "c": "gone", "d": "slipped", "e": "flat", "f": "new"}


def test_similar_runs_and_scripts_are_those_of_plain_comparison(spark, tmp_path):
    r = random.Random(6)
    runs = {f"r{i:02d}": [f"t{r.randint(0, 4)}" for _ in range(r.randint(1, 9))] for i in range(25)}
    s, _ = from_records(spark, tmp_path, *(run(i, *map(call, tools)) for i, tools in runs.items()))
    calls = {i: [(f'{t}:{{"q":1}}', t + " {q}") for t in tools] for i, tools in runs.items()}
    want = sorted(((-sequence.similarity(calls["r00"], c), i) for i, c in calls.items() if i != "r00"))[:7]
    assert [(-x.similarity, x.trace_id) for x in sequence.most_similar(s, "r00", 7).collect()] == want
    pairs = spark.createDataFrame([("r00", "r01"), ("r02", "r03")], "a string, b string")
    got = {(x.a, x.b, x.ordinal): (x.operation, x.at_a, x.at_b, x.likeness) for x in sequence.diff(s, pairs).collect()}
    assert got == {(a, b, n): e for a, b in (("r00", "r01"), ("r02", "r03")) for n, e in enumerate(sequence.edit_script(calls[a], calls[b]))}


def test_limits_by_plain_count(spark):
    draw = random.Random(3)
    span = 2_000_000
    rows = [(i, draw.choice(["a", "b", None]), draw.choice([None, *range(-3, 4)])) for i in range(300)]
    rows = [(i, s, None if t is None else t * span // 2 + draw.choice([-1, 0, 0, 1, 7])) for i, s, t in rows]
    rows += [(1000 + i, "c", None) for i in range(3)] + [(2000 + i, "d", span + i // 2) for i in range(9)] + [(3000, "e", 0), (3001, "e", span - 1), (3002, "e", span), (3003, "e", 2 * span)]
    posts = spark.createDataFrame(rows, "row long, sender string, received_us long")
    for most in (1, 3, 20):
        want = {i: sum(s == x and (t is None if u is None else t is not None and u - span < t <= u) for _, x, t in rows) <= most for i, s, u in rows}
        out = store.limited(posts, most, 2)
        assert out.columns == [*posts.columns, "allowed"] and {r.row: r.allowed for r in out.collect()} == want


def test_limits_need_no_growing_frame(spark):
    """Every post of a sender's last hour was counted anew for each post; and a sender was one task's."""
    plan = store.limited(spark.range(9).selectExpr("id AS row", "string(id % 2) AS sender", "id AS received_us"), 3, 3600)._jdf.queryExecution().toString()
    assert "RangeFrame, -" not in plan and "hashpartitioning(sender#" in plan and not re.search(r"hashpartitioning\(sender#\d+, \d", plan)


def test_counterfactual_against_removing_each_step(spark):
    """Each case's steps were dealt anew, with all their texts, and the rules' first pass was worked out for each use."""
    s = adapters.steps(spark, "/root/testdata/sf0.001").where("user_id < 4")
    t = adapters.traces(s)
    out = repair.counterfactual(s, t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(case#" not in plan
    cut = detect.run_rules(s, t).where("confidence >= 0.5").select("trace_id", F.col("step_index").alias("cut")).distinct()
    case = F.concat_ws("#", "trace_id", F.col("cut").cast("string"))
    place = (F.row_number().over(Window.partitionBy("trace_id").orderBy("step_index")) - 1).cast("long")
    left = s.join(cut, "trace_id").where("step_index <> cut").withColumn("trace_id", case).withColumn("step_index", place)
    still = {(r.trace_id, r.mode_id) for r in detect.run_rules(left, adapters.traces(left)).where("confidence >= 0.5").collect()}
    got = out.collect()
    assert got and {(f"{r.trace_id}#{r.step_index}", r.mode_id, r.eliminated) for r in got} == {(k, r.mode_id, (k, r.mode_id) not in still) for r in got for k in [f"{r.trace_id}#{r.step_index}"]}
    assert {r.eliminated for r in got} == {True, False}
