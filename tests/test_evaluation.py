import pytest
from pyspark.sql import functions as F

from evalspark.operators import evaluation as H
from evalspark.operators import failures as I


def test_completed_runs_take_latest_first(spark):
    rows = [
        ("complete-run", 1, "failed"), ("complete-run", 2, "completed"),
        ("failed-later", 1, "completed"), ("failed-later", 2, "failed"),
        ("no-status", 1, None),
    ]
    df = spark.createDataFrame(rows, "run_id string, t int, status string")
    assert {r["run_id"] for r in H.completed_runs(df, ["t"]).collect()} == {"complete-run", "no-status"}


def test_won_needs_exact_result(spark):
    ex = spark.createDataFrame(
        [(1, "m", "r", i, res, None, 1000) for i, res in enumerate(["CORRECT. NEXT GUESS?", "INCORRECT. x"])] + [(2, "m", "r", 0, "CORRECT", 0.5, 500)],
        "puzzle_id int, model string, run_id string, guess_index int, result string, cost double, latency_ms bigint",
    )
    got = {r["puzzle_id"]: r for r in H.item_difficulty(ex).collect()}
    assert (got[1]["wins"], got[1]["med_correct"], got[1]["med_cost"], got[1]["med_time_sec"]) == (0, 1.0, 0.0, 2.0)
    assert (got[2]["wins"], got[2]["solve_pct"]) == (1, 100.0)


SCORES = [
    ("correct", None, "gold", "correct_gold", 1.0),
    ("correct", None, "platinum", "correct_platinum", 1.0),
    ("correct", None, None, "correct_gold", 1.0),
    ("judge_correct", None, "none", "correct_judge", 1.0),
    ("error", "predicted_query_error", None, "error", 0.0),
    ("hit_limit", None, None, "hit_limit", 0.0),
    ("partial", "extra_columns:1", None, "partial_accepted", 1.0),
    ("partial", "extra_duplicates:1_x", None, "partial_accepted", 1.0),
    ("partial", "implicit_distinct:1_x", None, "partial_accepted", 1.0),
    ("partial", "aggregated_equivalent:3_to_1", None, "partial_accepted", 1.0),
    ("partial", "missing_columns:1", None, "partial_unaccepted", 0.0),
    ("partial", None, None, "partial_unaccepted", 0.0),
    ("incorrect", "missing_rows:1", None, "incorrect", 0.0),
]


def test_scores(spark):
    df = spark.createDataFrame([(i, *s[:3]) for i, s in enumerate(SCORES)], "i int, level string, partial_reason string, match_source string")
    got = [(r["category"], r["score"]) for r in H.score_result(df).orderBy("i").collect()]
    assert got == [s[3:] for s in SCORES]
    assert {r["level"] for r in H.needs_judge(df).collect()} == {"partial", "incorrect", "judge_correct"}
    assert H.needs_judge(df).count() == 4


def test_split_sizes(spark):
    rows = [(f"q{d}-{i}", f"db{d}") for d, n in enumerate([1, 2, 5, 10, 33]) for i in range(n)] + [("lone", None)]
    df = spark.createDataFrame(rows, "id string, db string")
    split = H.stratified_split(df, "id", "db", 0.3)
    got = {r["db"]: (r["train"], r["total"]) for r in H.split_distribution(split, "db").collect()}
    assert got == {"db0": (1, 1), "db1": (1, 2), "db2": (2, 5), "db3": (3, 10), "db4": (10, 33), "unknown": (1, 1), "TOTAL": (18, 52)}
    other = H.stratified_split(df, "id", "db", 0.3, seed="43")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, H.stratified_split(df, "id", "db", 0.3).collect()))
    assert split.exceptAll(other).count() > 0


def test_round_robin(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 7 else "a") for i in range(12)], "id int, db string")
    assert [r["db"] for r in H.round_robin_sample(df, "id", "db", 5).collect()] == ["a", "b", "c", "a", "b"]


def test_review_queue_order(spark):
    rows = [
        ("r1", 1, "correct", "gold", None), ("r1", 2, "partial", None, "extra_duplicates:1"), ("r1", 3, "correct", "platinum", None),
        ("r1", 4, "incorrect", None, None), ("r2", 4, "incorrect", None, None), ("r1", 5, "error", None, None),
    ]
    df = spark.createDataFrame(rows, "run_id string, question_id int, level string, match_source string, partial_reason string")
    df = df.withColumn("event_time", F.when(F.col("run_id") == "r1", 2).otherwise(1))
    reviewed = spark.createDataFrame([(5,)], "question_id int")
    second = spark.createDataFrame([(3,), (4,)], "question_id int")
    got = {(r["run_id"], r["question_id"]): (r["skip_reason"], r["reference_status"]) for r in H.review_queue(df, reviewed, second, "latest").collect()}
    assert got == {
        ("r1", 1): ("correct_gold", None), ("r1", 2): ("resolved_partial", None), ("r1", 3): ("correct_platinum", "PLATINUM_MATCH"),
        ("r1", 4): (None, "NOT_MATCHING"), ("r2", 4): ("wrong_run", "NOT_MATCHING"), ("r1", 5): ("already_reviewed", None),
    }


def test_cards_survive_malformed_numbers(spark):
    payloads = ['{"question_id":1,"correctness_level":"correct","is_correct":true,"cost_usd":"x","duration_ms":"soon"}', '{"question_id":"2","correctness_level":"error"}', "not json"]
    df = spark.createDataFrame([("r", None, "evaluation_result", p) for p in payloads], "run_id string, event_time timestamp, kind string, payload_json string")
    got = H.error_cards(df).collect()
    assert [r["correctness_level"] for r in got] == ["error", "incorrect", "correct"]
    assert (got[2]["question_id"], got[2]["cost_usd"], got[2]["duration_ms"], got[2]["score"]) == ("1", None, 0.0, 1.0)


def test_question_category_order(spark):
    texts = ["What percentage of most", "almost done", "the minimum", "average count", "how many", "summer", "difference", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    got = [r[0] for r in df.select(I.question_category(F.col("q"))).collect()]
    assert got == [
        "percentage_ratio_errors", "superlative_max_errors", "superlative_min_errors", "average_errors", "count_errors",
        "sum_total_errors", "difference_errors", "other_errors", "other_errors",
    ]
