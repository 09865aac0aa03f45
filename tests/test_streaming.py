import json

from spindrift.operators import sequence, stats
from spindrift.sources import adapters  # noqa: F401
from spindrift.streaming import live


def test_tail_announces_each_run_once(spark, tmp_path):
    inbox, checkpoint, seen = tmp_path / "in", str(tmp_path / "cp"), []
    inbox.mkdir()

    def drop(name, *ids):
        (inbox / name).write_text("\n".join(json.dumps({"id": i, "created_at": n, "steps": []}) for n, i in enumerate(ids)))

    drop("a.jsonl", "r1", "r2")
    live.tail(spark, str(inbox), checkpoint, live.on_batch(seen)).awaitTermination(120)
    drop("b.jsonl", "r2", "r3")
    live.tail(spark, str(inbox), checkpoint, live.on_batch(seen)).awaitTermination(120)
    assert seen == ["r1", "r2", "r3"]


def test_risk_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [("t", i, "tool_call", f"f{i % 2 if i < 6 else i}", i % 3 == 0, i % 5 == 4) for i in range(12)] + [("u", 0, "plan", "p", False, False)]
    steps = spark.createDataFrame(rows, "trace_id string, step_index long, kind string, fingerprint string, mutating boolean, is_verify boolean")
    steps.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).json(str(tmp_path / "in"))
    live.risk_monitor(stream, idle_ms=None).writeStream.format("memory").queryName("risk").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.trace_id, r.step_index): r.risk for r in spark.table("risk").collect()}
    want = {(r.trace_id, r.step_index): r.risk for r in sequence.risk(steps).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_risk_stream_with_precursors(spark, tmp_path):
    rows = [(t, i, "tool_call", f"f{t}{i}", f"t{(i * 7 + k) % 4}", '{"k": 1}', False, False) for k, t in enumerate("abc") for i in range(6)]
    steps = spark.createDataFrame(rows, "trace_id string, step_index long, kind string, fingerprint string, tool string, args_canon string, mutating boolean, is_verify boolean")
    runs = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "trace_id string, success boolean")
    model = stats.precursors(steps, runs)
    steps.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).json(str(tmp_path / "in"))
    watched = {r.gram: (r.occurrences, r.p_fail) for r in model.collect()}
    live.risk_monitor(stream, watched, None).writeStream.format("memory").queryName("risk2").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.trace_id, r.step_index): r.risk for r in spark.table("risk2").collect()}
    want = {(r.trace_id, r.step_index): r.risk for r in sequence.with_precursor(sequence.risk(steps), steps, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and max(got.values()) > 0


def test_levels_are_left_late():
    at = "nominal"
    said = []
    for r in (0.2, 0.35, 0.25, 0.15, 0.6, 0.5, 0.4, 0.9, 0.1, 0.9, 0.72, 0.69):
        at = sequence.level(at, r)
        said.append(at)
    # a watch is held while the risk stays above its floor, however high it rises
    assert said == ["nominal", "watch", "watch", "nominal", "elevated", "elevated", "watch", "watch", "nominal", "critical", "critical", "elevated"]


def test_inbox_drops_replays(spark, tmp_path):
    rows = [(1000.0, True, "ship", "s1", "{}"), (1001.0, True, "ship", "s1", "{}"), (1002.0, False, "ship", "s2", "{}"), (1003.0, True, "ping", "s3", "{}")]
    spark.createDataFrame(rows, "received_at double, verified boolean, kind string, signature string, payload string").coalesce(1).write.json(str(tmp_path / "in"))
    live.inbox(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("inbox").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.signature for r in spark.table("inbox").collect()) == ["s1", "s3"]
    assert {(r.kind, r.n, r.verified) for r in live.census(spark.read.json(str(tmp_path / "in"))).collect()} == {("ship", 3, 2), ("ping", 1, 1)}
