import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spindrift.operators import detect, rollup, sequence, stats
from spindrift.plans import catalogue, dsl

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()]
    assert sorted(map(str, [tuple(plain(r[c]) for c in columns) for r in got.collect()])) == sorted(map(str, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "trace_id"


def steps(spark, *calls):
    """Steps from (tool, error) or kind names."""
    rows = [("t", i, "tool_call", c[0], c[1], f"tool_call:{c[0]}") for i, c in enumerate(calls)]
    return spark.createDataFrame(rows, "trace_id string, step_index long, kind string, tool string, error string, fingerprint string")


def test_repeat_counts_failed_calls_between(spark):
    r = detect.repeat(steps(spark, ("a", None), ("a", "x"), ("b", None), ("a", None))).first()
    assert (r.step_index, round(r.confidence, 9)) == (3, 0.9)
    assert detect.repeat(steps(spark, ("a", None), *[(f"b{i}", None) for i in range(6)], ("a", None))).count() == 0


def test_cycle(spark):
    r = detect.cycle(steps(spark, *[("a", None), ("b", None)] * 9)).first()
    assert (r.step_index, round(r.confidence, 9)) == (0, 0.85)
    assert detect.cycle(steps(spark, *[(f"t{i}", None) for i in range(20)])).count() == 0


def test_expressions_are_refused_with_reasons():
    for text, why in [("steps >", "too early"), ("nothing == 1", "unknown field"), ("steps ~ 1", "can't read"), ("(steps > 1", "too early"), ("task matches '['", "bad pattern"), ("steps > 1 steps", "unexpected"), ("steps > 2d ago", "only created"), ("(" * 51 + "steps > 1", "parentheses")]:
        with pytest.raises(dsl.ExpressionError, match=why):
            dsl.tokens(text) and dsl._Parser(text, 0.0).whole()


def test_scales(spark):
    rows = spark.createDataFrame([("t", v) for v in (5, 5, 5, 5, 20000)], "trace_id string, v long")
    assert stats.scales(rows, ["trace_id"], "v").first().scale == pytest.approx(19995 / 5)


def test_p95_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("k", v) for v in range(1, 12)], "k string, v long")
    assert rollup.p95(rows, ["k"], "v", "p").first().p == 11


def test_alignment_and_edits():
    a, b = [("x:1", "x"), ("y:1", "y"), ("z:1", "z")], [("x:1", "x"), ("y:2", "y"), ("w:1", "w"), ("z:1", "z")]
    assert sequence.similarity(a, a) == 1.0 and sequence.similarity(a, []) == 0.0
    assert sequence.similarity(a, b) == sequence.similarity(b, a) == pytest.approx(4 / 8)
    assert [e[0] for e in sequence.edit_script(a, b)] == ["equal", "mutated", "inserted", "equal"]


def test_context():
    assert sequence.simulate("task", [("a", "x" * 40), ("b", "x" * 40), ("a", "x" * 8)], 13) == (13, 1, 2)


def test_chain(spark):
    rows = spark.createDataFrame([("t", i, f"f{i}", "r", None, "seed") for i in range(4)], "trace_id string, step_index long, fingerprint string, result string, error string, task string")
    signed = sequence.chain(rows, F.col("task"))
    assert sequence.tampered(signed, rows, F.col("task")).first().verdict == "intact"
    bad = rows.withColumn("result", F.when(F.col("step_index") == 2, "forged").otherwise(F.col("result")))
    r = sequence.tampered(signed, bad, F.col("task")).first()
    assert (r.verdict, r.step) == ("tampered", 2)


def test_fuzzy_prices(spark):
    rows = spark.createDataFrame([("GPT-X",), ("vendor/gpt-x",), ("other",)], "model string").select(rollup.fuzzy_rate(F.col("model"), {"gpt-x": 2.0}).alias("r"))
    assert [r.r for r in rows.collect()] == [2.0, 2.0, None]


def test_registered_queries_have_the_cycle_rule(spark, monkeypatch):
    """A run of 18 calls of two tools in turn, with changing arguments: the queries against verdicts made by hand."""
    import math
    from collections import defaultdict

    from spindrift.operators import attribution
    from spindrift.sources import adapters

    s = adapters.steps(spark, DATA).cache()
    trace = s.where("kind = 'tool_call' and error is null").join(adapters.traces(s).where("success = false").select("trace_id"), "trace_id", "left_semi").agg(F.min("trace_id")).first()[0]
    one = s.where((F.col("trace_id") == trace) & (F.col("kind") == "tool_call") & F.col("error").isNull()).orderBy("step_index").limit(1)
    more = one.crossJoin(spark.range(18)).withColumns({"step_index": (F.col("id") - 18).cast("long"), "tool": F.when(F.col("id") % 2 == 0, "ping").otherwise("pong"), "fingerprint": F.concat(F.lit("call "), F.col("id").cast("string"))}).drop("id")
    looped = s.unionByName(more.select(s.columns)).cache()
    monkeypatch.setattr(catalogue.adapters, "steps", lambda spark, d: looped)
    found = [*detect.run_rules(looped, adapters.traces(looped), cycles=False).collect(), *detect.cycle(looped).collect()]
    assert [(r.trace_id, r.mode_id) for r in found if r.rule == "cycle"] == [(trace, "FM-1.3")]
    prior = {r.mode_id: r.prior for r in attribution.modes(spark).collect()}
    scores = defaultdict(float)
    for r in found:
        if r.confidence >= 0.5:
            scores[r.trace_id, r.mode_id] += math.log(prior[r.mode_id] * 14) + math.log((r.confidence + 0.005) / (1.005 - r.confidence))
    got = {(r.trace_id, r.mode_id): r.score for r in catalogue.queries()["fusion_scores"](spark, DATA).collect()}
    assert got == pytest.approx(scores, abs=2e-6)
    best = {}
    for (t, m), x in scores.items():
        best[t] = min(best.get(t, (9e9, "")), (-x, m))
    said = {r.trace_id: r.primary_mode for r in catalogue.queries()["attribute"](spark, DATA).collect()}
    assert said == {t: best[t][1] if t in best else "OTHER" for t in said} and trace in said
    assert {r.mode_id: r.traces for r in catalogue.queries()["run_rules"](spark, DATA).collect()}["FM-1.3"] == sum(r.mode_id == "FM-1.3" for r in found)
    assert {r.trace_id: r["mode"] for r in catalogue.queries()["triage"](spark, DATA).collect()}[trace] == best[trace][1]
