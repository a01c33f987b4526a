import uuid

import pytest
from pyspark.sql import functions as F

from evalspark.functions import ids
from evalspark.operators import ledger as L
from evalspark.operators import runs as C
from evalspark.session import fresh_dir
from evalspark.sources import ledger_files as LF

T0 = "2026-05-26T10:00:0{}+00:00"
EVENTS = [
    # event_id, second, kind, run_id
    ("e1", 0, "model_prompt", "run-a"),
    ("e2", 1, "model_completion", "run-a"),
    ("e3", 2, "task_done", "run-a"),
    ("e4", 3, "model_prompt", "run-b"),
    ("e5", 4, "model_completion", "run-b"),
    ("e6", 5, "task_failed", "run-b"),
]
POSTINGS = [
    ("e2", "truth.money", "project:demo", "$", -0.002),
    ("e2", "truth.money", "vendor:v", "$", 0.002),
    ("e2", "truth.time", "agent:a", "ms", 1500.0),
    ("e2", "truth.time", "project:demo", "ms", -1500.0),
    ("e3", "truth.utility", "task:t1", "points", 1.0),
    ("e3", "truth.utility", "project:demo", "points", -1.0),
    ("e5", "truth.money", "project:demo", "$", -0.006),
    ("e5", "truth.money", "vendor:v", "$", 0.005),
    ("e5", "truth.time", "agent:a", "ms", 2200.0),
    ("e5", "truth.time", "project:demo", "ms", -2200.0),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(e, T0.format(s), T0.format(s), k, "solver", "t1", "demo", r, "sdk", e, "{}") for e, s, k, r in EVENTS]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in LF.EVENT_SCHEMA.fieldNames()))
    return LF.normalize_contract(df, "events")


@pytest.fixture(scope="module")
def postings(spark):
    rows = [(f"p{i}", e, t, a, u, d, "{}") for i, (e, t, a, u, d) in enumerate(POSTINGS)]
    return spark.createDataFrame(rows, LF.POSTING_SCHEMA)


def test_ids_equal_python(spark):
    names = [("demo", "k1"), ("p", "ä/ü"), ("", "x" * 300)]
    df = spark.createDataFrame(names, "p string, k string")
    space = uuid.UUID(ids.ID_NAMESPACE)
    got = [r[0] for r in df.select(ids.deterministic_event_id(F.col("p"), F.col("k"))).collect()]
    assert got == [str(uuid.uuid5(space, f"{p}\0{k}")) for p, k in names]
    got = [r[0] for r in df.select(ids.deterministic_posting_id(F.col("k"), F.lit(3))).collect()]
    assert got == [str(uuid.uuid5(space, f"{k}\0posting:3")) for _, k in names]


def test_run_summary(events, postings):
    got = {r["run_id"]: r for r in C.run_summary(events, postings).collect()}
    a, b = got["run-a"], got["run-b"]
    assert (a["event_count"], a["kind_count"], a["cost"], a["latency_ms"], a["utility"], a["invariant_ok"]) == (3, 3, 0.002, 1500, 1, True)
    assert (b["event_count"], b["cost"], b["latency_ms"], b["utility"], b["invariant_ok"]) == (3, 0.005, 2200, 0, False)
    assert C.latest_run_id(events).collect()[0]["run_id"] == "run-b"


def test_trial_balance_needs_unit(spark, postings):
    found = L.trial_balance(postings).collect()
    assert [(r["account_type"], r["unit"], round(r["net"], 6)) for r in found] == [("truth.money", "$", -0.001)]
    two = spark.createDataFrame([("truth.money", "$", 1.0), ("truth.money", "eur", -1.0)], "account_type string, unit string, delta_numeric double")
    assert L.trial_balance(two).count() == 2


def test_event_balance(postings):
    assert [r["event_id"] for r in L.check_event_balance(postings).collect()] == ["e5"]


def test_null_run_is_a_run(spark, events, postings):
    mixed = events.withColumn("run_id", F.when(F.col("run_id") == "run-a", F.col("run_id")))
    got = {r["run_id"]: r["event_count"] for r in C.run_summary(mixed, postings).collect()}
    assert got == {"run-a": 3, None: 3}
    assert C.run_scope_filter(mixed, [None]).count() == 3
    assert C.run_scope_filter(mixed, []).count() == 6
    assert L.trial_balance(postings, mixed, run=None).count() == 1
    assert L.trial_balance(postings, mixed, run="run-a").count() == 0


def test_latest_run_of_nothing(events):
    assert C.latest_run_id(events.limit(0)).count() == 0


def test_kind_counts(events):
    got = {r["kind"]: r["count"] for r in C.kind_counts(events).collect()}
    assert got == {"model_prompt": 2, "model_completion": 2, "task_done": 1, "task_failed": 1}


def test_reingest_adds_nothing(events):
    fresh, counts = L.ingest_idempotent(events.unionByName(events), events, "event_id", ["ingest_time"])
    assert fresh.count() == 0
    assert counts.collect()[0].asDict() == {"received": 12, "distinct_ids": 6, "inserted": 0}


def test_read_ledger(spark, events, tmp_path):
    folder = tmp_path / "deep" / "run"
    folder.mkdir(parents=True)
    line = '{"event_id":"%s","event_time":"2026-01-01T00:00:00Z","ingest_time":"2026-01-0%dT00:00:00Z","kind":"k%d","payload_json":{"a":1}}'
    (folder / "events.jsonl").write_text("\n".join([line % ("x", 1, 1), "", line % ("x", 2, 2), line % ("y", 1, 3)]) + "\n")
    (folder / "other.jsonl").write_text('{"event_id":"z"}\n')
    for source in (str(tmp_path), str(folder / "events.jsonl")):
        ev, po = LF.read_ledger(spark, source)
        assert {(r["event_id"], r["kind"], r["payload_json"]) for r in ev.collect()} == {("x", "k2", '{"a":1}'), ("y", "k3", '{"a":1}')}
        assert po.count() == 0 and po.schema == LF.POSTING_SCHEMA


def test_round_trip(spark, events, postings):
    folder = fresh_dir(spark, "ledger")
    LF.write_ledger(events, postings, folder)
    ev, po = LF.read_ledger(spark, folder)
    assert ev.exceptAll(events).count() == 0 and ev.count() == 6
    assert po.exceptAll(postings).count() == 0 and po.count() == 10


def test_builders_balance(spark):
    calls = spark.createDataFrame(
        [("x1", "demo", "v", "a", "m", 10, 4, 900, 0.25), ("x2", "demo", "v", "a", "m", 3, 1, 50, None)],
        "exchange_id string, project_id string, provider string, agent_id string, model string, prompt_tokens int, completion_tokens int, wall_ms int, cost_money double",
    )
    legs = L.build_postings_model_call(calls)
    counts = {r["idempotency_key"]: r["count"] for r in legs.groupBy("idempotency_key").count().collect()}
    assert counts == {"x1:prompt": 2, "x1:completion": 6, "x2:prompt": 2, "x2:completion": 4}
    net = legs.groupBy("idempotency_key", "account_type", "unit").agg(F.sum("delta_numeric").alias("n"))
    assert net.filter("abs(n) > 1e-12").count() == 0


def test_matrix_progression(spark):
    def cell(i, run, q, ok):
        ok = {True: "true", False: "false", None: "null"}[ok]
        return (f"m{i}", f"2026-01-0{1 if run == 'run-1' else 2}T00:00:00Z", "evaluation_result", run, f'{{"question_id":"{q}","is_correct":{ok}}}')

    cells = [("run-1", "q1", False), ("run-2", "q1", True), ("run-1", "q2", True), ("run-2", "q2", False), ("run-1", "q3", True), ("run-2", "q3", True), ("run-2", "q4", None)]
    ev = spark.createDataFrame([cell(i, *c) for i, c in enumerate(cells)], "event_id string, event_time string, kind string, run_id string, payload_json string")
    ev = ev.withColumn("event_time", F.to_timestamp("event_time"))
    runs = ev.groupBy("run_id").agg(F.min("event_time").alias("first_time"))
    trans = C.matrix_transitions(C.eval_matrix(ev), runs)
    assert {(r["question_id"], r["kind"]) for r in trans.collect() if r["kind"]} == {("q1", "prog"), ("q2", "regr")}
    order = [r["question_id"] for r in C.matrix_volatility(trans).collect()]
    assert order == ["q1", "q2", "q3", "q4"]
    wide = {r["question_id"]: (r["run_1"], r["run_2"]) for r in C.matrix_pivot(C.eval_matrix(ev), ["run-1", "run-2"]).collect()}
    assert wide["q1"] == (False, True) and wide["q4"] == (None, False)


def test_lifecycle(spark):
    moves = [("t1", 1, "NEW", "WIP"), ("t1", 2, "WIP", "DONE"), ("t2", 1, "NEW", "WIP"), ("t2", 2, "NEW", "WIP"), ("t2", 3, "WIP", "FAILED"), ("t2", 4, "WIP", "DONE"), ("t3", 1, "NEW", "WIP")]
    ev = spark.createDataFrame(
        [(f"{t}-{s}", t, f"2026-01-0{s}T00:00:00Z", f'{{"from":"{a}","to":"{b}"}}') for t, s, a, b in moves], "event_id string, actor_task_id string, t string, payload_json string"
    ).select("event_id", "actor_task_id", F.to_timestamp("t").alias("event_time"), "payload_json", F.lit("state_move").alias("kind"))
    got = {r["task_id"]: r for r in L.task_lifecycle_check(ev).collect()}
    assert (got["t1"]["starts"], got["t1"]["ends"], got["t1"]["broken_links"], got["t1"]["moves_after_end"]) == (1, 1, 0, 0)
    assert (got["t2"]["starts"], got["t2"]["ends"], got["t2"]["broken_links"], got["t2"]["moves_after_end"]) == (2, 2, 2, 1)
    assert got["t3"]["is_open"]


def test_dedupe_deals_rows_before_it_sorts_them(spark):
    rows = [("hot", i, f"p{i}") for i in range(300)] + [("hot", 299, "p300")] * 3 + [(f"e{i}", 1, None) for i in range(20)] + [(None, 9, "lost")]
    events = spark.createDataFrame(rows, "event_id string, ingest_time int, payload_json string")
    found = L.dedupe_latest(events, "event_id", ["ingest_time"])
    want = {("hot", 299, "p300")} | {(f"e{i}", 1, None) for i in range(20)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange") > plan.rindex("Aggregate")
