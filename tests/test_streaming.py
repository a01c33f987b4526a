from pyspark.sql import functions as F

from evalspark.session import fresh_dir
from evalspark.sources.ledger_files import EVENT_SCHEMA
from evalspark.streaming import ledger_streams as S


def events(spark, rows):
    """rows: (event_id, minute, kind, task, payload)"""
    df = spark.createDataFrame(rows, "event_id string, minute int, kind string, actor_task_id string, payload_json string")
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60)
    df = df.withColumn("event_time", time).withColumn("ingest_time", time)
    for f in EVENT_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(EVENT_SCHEMA.fieldNames())


def move(i, minute, task, a, b):
    return (f"e{i}", minute, "state_move", task, f'{{"from":"{a}","to":"{b}"}}')


def run(spark, batches, build):
    """Feed the batches one after the other through one checkpoint."""
    source, out, state = (fresh_dir(spark, n) for n in ("in", "out", "state"))
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        df = build(S.read_stream(spark, source, EVENT_SCHEMA))
        S.write_append(df, out, state)
    return spark.read.parquet(out)


DAY = 24 * 60


def test_task_state_over_restarts(spark):
    batches = [
        [move(1, 0, "t1", "NEW", "WIP"), move(2, 1, "t2", "WIP", "DONE"), move(3, 2, "t3", "NEW", "WIP")],
        [move(4, 10, "t1", "WIP", "DONE"), move(5, 11, "t1", "WIP", "FAILED"), move(6, 12, "t3", "NEW", "WIP")],
        [move(7, 5 * DAY, "t9", "NEW", "WIP")],
        [move(8, 5 * DAY + 1, "t9", "WIP", "DONE"), move(9, 5 * DAY + 1, "t3", "NEW", "WIP")],
        [("h1", 50 * DAY, "heartbeat", None, "{}")],
        [("h2", 90 * DAY, "heartbeat", None, "{}")],
    ]
    got = run(spark, batches, S.stream_task_state)
    verdicts = {r["event_id"]: r["verdict"] for r in got.collect() if r["event_id"]}
    assert verdicts == {"e1": "legal", "e2": "wrong_start", "e3": "legal", "e4": "legal", "e5": "after_end", "e6": "broken_chain", "e7": "legal", "e8": "legal", "e9": "legal"}
    # t3 twice: it started anew after its first timeout
    assert sorted((r["task_id"], r["from_state"]) for r in got.filter("verdict = 'timeout'").collect()) == [("t3", "WIP"), ("t3", "WIP")]


def test_moves_are_judged_in_time_order(spark):
    """Whatever order they arrive in, also over batches, while the watermark allows it."""
    batches = [
        [move(2, 30, "t1", "WIP", "DONE"), move(1, 20, "t1", "NEW", "WIP")],
        [move(0, 5, "t1", "NEW", "NEW"), move(3, 30, "t1", "DONE", "WIP")],
        [("h", 3 * DAY, "heartbeat", None, "{}")],
    ]
    got = run(spark, batches, S.stream_task_state).orderBy("event_time", "event_id").collect()
    assert [(r["event_id"], r["verdict"]) for r in got if r["event_id"]] == [("e0", "legal"), ("e1", "legal"), ("e2", "legal"), ("e3", "after_end")]


def upserts(spark, batches, build, keys):
    source, out, state = (fresh_dir(spark, n) for n in ("in", "out", "state"))
    seen = []
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        df = build(S.read_stream(spark, source, EVENT_SCHEMA))
        S.write_upserts(df, out, state)
        seen.append(S.read_upserts(spark, out, df.schema, keys))
    return seen


def test_open_sessions_are_upserted(spark):
    at = lambda i, minute, task="t1": (f"e{i}", minute, "k", task, "{}")
    batches = [[at(1, 0), at(2, 40), at(3, 0, "t2")], [at(4, 20), at(5, 300)], [at(6, 310), at(7, 2000, "t2")]]
    stages = upserts(spark, batches, lambda df: S.stream_sessions(df, "actor_task_id", "30 minutes"), ["actor_task_id", "session_start"])
    found = [sorted((r[0], (r[1].timestamp() - 1_700_000_000) / 60, (r[2].timestamp() - 1_700_000_000) / 60, r[3]) for r in S.sessions(x).collect()) for x in stages[-1:]]
    assert found == [[("t1", 0, 70, 3), ("t1", 300, 340, 2), ("t2", 0, 30, 1), ("t2", 2000, 2030, 1)]]


def test_repeated_batch_replaces_itself(spark):
    df = spark.createDataFrame([(1, 5)], "k long, n long")
    out = fresh_dir(spark, "out")
    for number, n in ((0, 1), (1, 2), (1, 3), (0, 1)):
        df.selectExpr("k", f"cast({n} as long) as n").write.mode("overwrite").parquet(f"{out}/batch_id={number}")
    assert [tuple(r) for r in S.read_upserts(spark, out, df.schema, ["k"]).collect()] == [(1, 3)]


def test_open_windows_and_prompts(spark):
    call = lambda i, minute, kind, x: (f"e{i}", minute, kind, "t", f'{{"exchange_id":"{x}"}}')
    batches = [
        [call(1, 0, "model_prompt", "a"), call(2, 1, "model_prompt", "b"), call(3, 2, "model_completion", "a")],
        [call(4, 50, "model_completion", "b"), call(5, 51, "model_prompt", "c"), call(6, 52, "model_completion", "a")],
    ]
    pairs = S.exchanges(run(spark, batches, S.stream_exchange_join)).collect()
    assert sorted((r["prompt_id"], r["completion_id"]) for r in pairs if r["completion_id"]) == [("e1", "e3"), ("e1", "e6"), ("e2", "e4")]
    assert [r["prompt_id"] for r in pairs if r["completion_id"] is None] == ["e5"]
    first, second = upserts(spark, batches, lambda df: S.stream_kind_windows(df, "1 hour"), ["window_start", "window_end", "kind"])
    counts = lambda x: sorted((r["kind"], r["n"]) for r in x.groupBy("kind").sum("n").withColumnRenamed("sum(n)", "n").collect())
    assert counts(second) == [("model_completion", 3), ("model_prompt", 3)]


def test_dedupe_across_batches(spark):
    batches = [[("a", 0, "k", "t", "{}"), ("b", 1, "k", "t", "{}")], [("a", 2, "k", "t", "{}"), ("c", 3, "k", "t", "{}")]]
    got = run(spark, batches, lambda df: S.stream_dedupe(df).select("event_id"))
    assert sorted(r[0] for r in got.collect()) == ["a", "b", "c"]


def test_ingest_twice(spark):
    target, source = fresh_dir(spark, "table"), fresh_dir(spark, "in")
    rows = [("a", 0, "k", "t", "{}"), ("a", 0, "k", "t", "{}"), ("b", 2000, "k", "t", "{}")]
    events(spark, rows).write.parquet(source)
    for _ in range(2):
        S.stream_ingest(S.read_stream(spark, source, EVENT_SCHEMA), target, fresh_dir(spark, "state"))
    assert sorted(r["event_id"] for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_parts_of_a_stream_keep_their_files(spark, monkeypatch):
    """A half of the events is one batch of all its files, and nothing is brought into one task for it."""
    from types import SimpleNamespace

    from evalspark.catalog import stream as C

    rows = spark.range(0, 400, 1, 8).selectExpr("timestamp_seconds(id * 3600) as event_time", "concat('k', id % 3) as kind")
    seen, read = [], S.read_stream
    monkeypatch.setattr(S, "read_stream", lambda s, path, schema: seen.append(s.read.parquet(path).inputFiles()) or read(s, path, schema))
    got = C._upserted(SimpleNamespace(spark=spark), C._in_two(rows), S.stream_kind_windows, ["window_start", "window_end", "kind"])
    want = rows.groupBy(F.date_trunc("day", "event_time").alias("d"), "kind").count()
    assert sorted(map(tuple, got.select("window_start", "kind", "n").collect())) == sorted(map(tuple, want.collect()))
    assert len(seen) == 2 and len(seen[0]) >= 4 and len(seen[1]) - len(seen[0]) >= 4
