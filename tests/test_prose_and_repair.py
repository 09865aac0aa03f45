import math
import os

import duckdb
import pytest

from spindrift.operators import attribution, detect, fleet, prose, repair, sequence
from spindrift.plans import catalogue
from spindrift.sources import adapters

DATA = "/root/testdata/sf0.001"
A = "The planner reads the whole request and lists the files that it is going to change first."


def test_repeat_and_restart():
    others = ["first the configuration is read", "then wheels get built for every platform", "at last all of it goes to staging"]
    assert prose.find_repeat(["opening words", others[0], A, others[1], A + "!"]) == 4
    assert prose.find_repeat([A, others[0], others[1], A]) is None  # the opening again: a restart
    assert prose.find_restart([A, *others, A], "t") == (4, 0.75)
    assert prose.find_restart([A, *others[:2], A.replace("whole request", "entire request again")], "t")[0] == 3
    assert prose.find_restart(["short", "so: " + A], A) == (1, 0.6)
    assert prose.find_restart(["short", "turns"], A) is None


def test_divergence():
    thought = "Thought: look at `parser.tokens` and core.lexer.scan for the bug. "
    assert prose.find_divergence(["hello", thought + "Action: write_report(summary_of_weather_data)"]) == 1
    assert prose.find_divergence([thought + "Action: open the lexer module and read it"]) is None
    assert prose.find_divergence([thought + "Action: short"]) is None


def test_rules_in_words(spark):
    rows = [(1, 0, "user", "please repair the harvester engine now"), *((1, i, "assistant", f"the harvester part {i}") for i in (1, 2)), *((1, i, "assistant", f"other matters {i}") for i in (3, 4, 5)), (2, 0, "user", "go on"), (2, 1, "assistant", "the data is insufficient"), (2, 2, "assistant", "we have fixed the issue"), (3, 0, "user", None), (3, 1, "assistant", "")]
    t = prose.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.trace_id, r.rule): r.step_index for r in prose.run_rules(t).collect()}
    assert got == {("1", "prose_no_verify"): 4, ("1", "prose_derail"): 2, ("2", "prose_ambiguity"): 0, ("2", "prose_outcome"): 1}


def test_steps_are_dealt_in_parts_that_grow_with_the_table(spark, monkeypatch):
    """Spark chose the parts by exchanged bytes, before the texts of steps are made: a task's memory grew with the table."""
    monkeypatch.setattr(adapters, "FEW", 10**9)
    s = adapters.steps(spark, DATA)
    want = {tuple(r) for r in detect.run_rules(s, adapters.traces(s)).collect()}
    monkeypatch.setattr(adapters, "FEW", 2)
    size = os.path.getsize(f"{DATA}/events.parquet")
    for parts in (3, 13):
        monkeypatch.setattr(adapters, "PART_BYTES", -(-size // parts))
        s = adapters.steps(spark, DATA)
        assert s.rdd.getNumPartitions() == parts
    found = detect.run_rules(s, adapters.traces(s))
    assert {tuple(r) for r in found.collect()} == want
    assert found.rdd.getNumPartitions() % 13 == 0  # no later exchange puts them together again


def test_odd_numbers_and_days(spark, tmp_path):
    props = ['{"k": 12}', '{"k": 0}', '{"k": 007}', '{"k":5}', '{"k": 12}\n', '{"k": 12} ', '{"k": -3}', '{"k": "4"}', '{"k": 999999999999999999}', '{"k": 9223372036854775807}', '{"k": ٣}', '{"k": 1, "j": 2}', "{}", "", None]
    days = ["2024-01-01", "2024-12-31", "0999-12-31", "1000-01-06", "0001-01-05", "9999-12-31", None]
    rows = [(i, p, days[i % len(days)]) for i, p in enumerate(props * 2)]
    e = spark.createDataFrame(rows, "event_id long, props string, day string").selectExpr("event_id", "to_timestamp(day) AS ts", "event_id AS user_id", "'view' AS event_type", "1.0D AS value", "props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    plain = e.selectExpr("event_id", "cast(get_json_object(props, '$.k') AS long) AS k", "concat_ws('-', event_id, replace(cast(date_sub(cast(ts AS date), weekday(cast(ts AS date))) AS string), '-', '')) AS trace_id")
    assert {tuple(r) for r in adapters._events(spark, str(tmp_path)).select("event_id", "k", "trace_id").collect()} == {tuple(r) for r in plain.collect()}


def test_words_end_where_they_do_in_sql(spark):
    odd = ["die ätest ertz", "prüf-ütest", "ſtest", "checké it", "wir teſt es", "conﬁrm", "atest", "verifiziert", "étest2", "Keep", "retést"]
    rows = [(c, i, "assistant", text if i == 2 else "more") for c, text in enumerate(odd) for i in range(4)] + [(c, 4, "user", x) for c, x in enumerate(["éproceed", "go oné", "Keep going", "proſeed"])]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {(r.trace_id, r.step_index) for r in prose.no_verify(prose.turns(talk)).collect()}
    want = {(r[2], r[3]) for r in duck.execute(catalogue.oracle_sql()["prose_no_verify"]).fetchall()}
    assert got == want and ("0", 3) not in got and ("6", 3) in got
    told = catalogue.oracle_sql()["prose_no_verify"].split("SELECT 'FM-3.2'")[0] + "SELECT DISTINCT trace_id, nudged FROM t"
    assert {(r.trace_id, r.nudged) for r in prose.turns(talk).collect()} == set(duck.execute(told).fetchall())


def test_one_pass_gives_what_the_rules_give(spark):
    s = adapters.steps(spark, DATA)
    t = adapters.traces(s)
    one = [detect.repeat(s), detect.long_loop(s, t), detect.reset(s), detect.premature(t), detect.missing_verify(s), detect.weak_verify(s), detect.intent_mismatch(s), detect.derail(s), detect.forbidden(s, t), detect.clarify(s, t), detect.withhold(s), detect.ignored(s), detect.role(s, t), detect.lost_reference(s)]
    want = {tuple(r) for f in one for r in f.collect()}
    assert {tuple(r) for r in detect.run_rules(s, t, cycles=False).collect()} == want


def test_repair(spark):
    s = adapters.steps(spark, DATA)
    t = adapters.traces(s)
    mended = repair.with_checks(repair.without_repeats(s))
    ends = adapters.traces(mended) if "ts_us" in mended.columns else t
    after = {r.mode_id for r in detect.missing_verify(mended).collect()}
    assert after == set() and ends is not None
    for r in repair.plan_repair(s, t).collect():
        assert "FM-3.2" not in r.remaining and not set(filter(None, r.cleared.split(","))) & set(filter(None, r.remaining.split(",")))


def test_conformal(spark):
    scores = spark.createDataFrame([(f"t{i}", m, 2.0 if m == "a" else 0.0) for i in range(40) for m in "abc"], "trace_id string, mode_id string, score double")
    gold = spark.createDataFrame([(f"t{i}", "a" if i < 36 else "b") for i in range(40)], "trace_id string, mode_id string")
    p = repair.softmax(scores, 1.0)
    at = repair.conformal_threshold(p, gold)
    top = math.exp(2) / (math.exp(2) + 2)
    assert at == pytest.approx(1 - (1 - top) / 2) or at == pytest.approx(1 - top)
    assert {r.modes for r in repair.conformal_sets(p, 1 - top + 1e-9).collect()} == {"a"}
    assert 0.5 <= repair.fit_temperature(scores, gold, rounds=6) <= 5.0


def test_duplicates_and_merge(spark):
    rows = [(t, i, "tool_call", x, "{}") for t, calls in {"a": "xyz", "b": "xyz", "c": "pqr"}.items() for i, x in enumerate(calls)]
    steps = spark.createDataFrame(rows, "trace_id string, step_index long, kind string, tool string, args_canon string")
    assert {(r.trace_id, r.representative) for r in repair.duplicate_groups(steps).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    one, two = (spark.createDataFrame(x, "trace_id string, content string") for x in ([("1", "a"), ("2", "b"), ("3", "c")], [("2", "b"), ("3", "x"), ("4", "d")]))
    assert {(r.trace_id, r.status) for r in repair.merge(one, two).collect()} == {("1", "new"), ("2", "same"), ("3", "conflict"), ("4", "kept")}


def test_ledger(spark):
    from hashlib import sha256

    rows, chain = [], ""
    for seq in range(1, 6):
        chain = sha256(f"{chain}{seq}|t{seq}|r{seq}".encode()).hexdigest()
        rows.append((seq, f"t{seq}", f"r{seq}", chain))
    schema = "seq long, trace_id string, root string, chain string"
    assert sequence.ledger_breaks(spark.createDataFrame(rows, schema)).count() == 0
    rows[2] = (3, "t3", "forged", rows[2][3])
    assert [r.seq for r in sequence.ledger_breaks(spark.createDataFrame(rows, schema)).collect()] == [3]


def test_alerts(spark):
    s = spark.createDataFrame([("a", 0.5, 3, 2.0, 0), ("b", 0.0, 0, 0.0, 0)], "store string, failure_rate double, anomalies long, est_spend double, breaches long")
    assert {(r.store, r.reasons, r.alert) for r in fleet.alerts(s, rate=0.5, spend=2.0).collect()} == {("a", "failure rate", True), ("b", "", False)}
    assert [r.alert for r in fleet.alerts(s, spend=2.0).orderBy("store").collect()] == [True, False]


def test_modes_add_up(spark):
    assert sum(r.prior for r in attribution.modes(spark).collect()) == pytest.approx(1)
