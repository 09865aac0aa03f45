import json

from pyspark.sql import functions as F

from spindrift.sources import records, sinks



def step(kind, **more):
    return dict(kind=kind, **more)


def say(role, content, **more):
    return dict(role=role, content=content, **more)


def call(i, name, arguments):
    return dict(id=i, type="function", function=dict(name=name, arguments=arguments))


def span(i, name, start, end, code, parent=None, attributes=()):
    return dict(traceId="T", spanId=i, name=name, startTimeUnixNano=start, endTimeUnixNano=end, status=dict(code=code), attributes=list(attributes), **({"parentSpanId": parent} if parent else {}))


NATIVE = dict(id="abc", task="t", created_at=5, model="m", success="TRUE", meta={"a": 1}, steps=[step("tool_call", tool="get", args=dict(b=2, a=1), result="ok", tokens=3.9, latency_ms=-5), step("plan", thought="x", args=[], meta="x", tokens=True)])
CHAT = dict(messages=[say("user", "do it"), say("assistant", None, tool_calls=[call("1", "go", '{"k": 1}'), call("2", "bad", "oops")]), say("tool", "boom", name="go", is_error=True), say("assistant", "done")], metadata=dict(trace_id="0123456789ab"))
USED = dict(key="gen_ai.usage.total_tokens", value=dict(intValue="7"))
OTLP = dict(resourceSpans=[dict(scopeSpans=[dict(spans=[span("b", "call", "2000000000", "2005000000", 2, "a", [USED]), span("a", "root", "1000000000", "3000000000", 1)])])])


def write(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n")
    return str(path)


def test_all_kinds(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", NATIVE, CHAT, [say("user", "hi")], OTLP, "{torn", "[1", {"id": "x", "steps": {}}, {"nothing": 1}, dict(id="../../pwn", steps=[]))
    got = {r.trace_id: r for r in records.read(spark, path).collect()}
    assert len(got) == 4
    a = got["abc"]
    assert (a.created_at, a.success, json.loads(a.meta)) == (5.0, True, {"a": 1})
    assert [(s.kind, s.tool, json.loads(s.args), s.tokens, s.latency_ms) for s in a.steps] == [("tool_call", "get", {"a": 1, "b": 2}, 3, 0), ("plan", None, {}, 0, 0)]
    c = got["0123456789ab"]
    assert c.task == "do it" and c.success is False
    assert [(s.kind, s.tool) for s in c.steps] == [("message", None), ("tool_call", "go"), ("tool_call", "bad"), ("observation", "go"), ("response", None)]
    assert json.loads(c.steps[2].args) == {"raw": "oops"} and c.steps[3].error == "boom"
    o = next(r for r in got.values() if r.task == "root")
    assert o.success is True and [(s.kind, s.tokens, s.latency_ms, s.error) for s in o.steps] == [("tool_call", 7, 5, "error")]
    assert sorted(r.why for r in records.rejected(records.lines(spark, path)).collect()) == ["not JSON", "not JSON", "not a record", "steps are no list"]


def test_coercion(spark, tmp_path):
    cases = [(True, 0.0), ("x", 0.0), (None, 0.0), (12.5, 12.5)]
    path = write(tmp_path / "c.jsonl", *({"id": f"a{i}", "created_at": v, "steps": []} for i, (v, _) in enumerate(cases)))
    assert {r.trace_id: r.created_at for r in records.read(spark, path).collect()} == {f"a{i}": w for i, (_, w) in enumerate(cases)}
    counts = [(-5, 0), (True, 0), ("7", 0), (1e30, 10_000_000), (3.9, 3)]
    outcomes = [("TRUE", True), (1, True), (0, False), ("yes", None), (None, None), (" false ", False)]
    path = write(tmp_path / "d.jsonl", *(dict(id=f"n{i}", steps=[step("plan", tokens=v)]) for i, (v, _) in enumerate(counts)), *({"id": f"s{i}", "success": v, "steps": []} for i, (v, _) in enumerate(outcomes)))
    got = {r.trace_id: r for r in records.read(spark, path).collect()}
    assert [got[f"n{i}"].steps[0].tokens for i in range(len(counts))] == [w for _, w in counts]
    assert [got[f"s{i}"].success for i in range(len(outcomes))] == [w for _, w in outcomes]


def test_round_trip(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", NATIVE)
    first = records.read(spark, path)
    sinks.native_lines(first).write.text(str(tmp_path / "out"))
    assert records.read(spark, str(tmp_path / "out")).collect() == first.collect()
    sinks.chat_lines(first).write.text(str(tmp_path / "chat"))
    assert records.read(spark, str(tmp_path / "chat")).first().task == "t"
    assert records.new_records(first, first).count() == 0
    assert sinks.csv_rows(records.exploded(first).withColumns({"task": F.lit("t"), "model": F.lit("m"), "args_canon": F.lit("{}")}), first.select("trace_id", "success", F.lit(0).alias("created_us"), F.lit(False).alias("breached"))).count() == 2
