import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import text as J

GROUPS = [["A", "B", "C", "D"], ["e", "F", "G", "H"], ["I", "J", "K", "L"], ["M", "N", "O", "P"]]


def test_guess_features(spark):
    guesses = ["A, B, C, d", "E,F,G,M", "A, F, K, P", "A, B, C", "A, B, C, ZZZ", "A, B, C, A"]
    attempts = spark.createDataFrame([(1, 1, i, f"<guess>{g}</guess>") for i, g in enumerate(guesses)], "run_id int, puzzle_id int, guess_index bigint, response string")
    puzzles = spark.createDataFrame([(1, GROUPS)], "puzzle_id int, groups array<array<string>>")
    got = {r["guess_index"]: (r["overlap"], r["formal_error"]) for r in J.guess_features(attempts, puzzles).collect()}
    assert got == {
        0: ([4, 0, 0, 0], None), 1: ([0, 3, 0, 1], None), 2: ([1, 1, 1, 1], None), 3: ([3, 0, 0, 0], "wrong_count"),
        4: ([3, 0, 0, 0], "unknown_word"), 5: ([3, 0, 0, 0], "duplicate_words"),
    }


def steps(spark, *messages):
    df = spark.createDataFrame([("t", f"[{','.join(messages)}]")], "trace_id string, json string")
    return J.flatten_trace(J.explode_messages(df, "json"))


CALL = '{"role":"assistant","content":null,"tool_calls":[%s]}'


def test_more_calls_than_letters(spark):
    calls = ",".join('{"id":"i%d","name":"q%d"}' % (i, i) for i in range(60))
    labels = {r["name"]: r["label"] for r in J.pair_tool_calls(steps(spark, CALL % calls)).collect()}
    assert len(set(labels.values())) == 60
    assert [labels[f"q{i}"][1:] for i in (0, 25, 26, 51, 52)] == ["a", "z", "aa", "az", "ba"]


def test_first_open_call_and_unanswered(spark):
    st = steps(
        spark,
        CALL % '{"id":"a","function":{"name":"q1"}},{"id":"b","name":"q2"}',
        '{"role":"tool","tool_call_id":"b","content":"rb"}',
        '{"role":"tool","content":"ra"}',
        CALL % '{"id":"c","name":"q3"}',
    )
    got = sorted((r["name"], r["label"], r["result"], r["answered"]) for r in J.pair_tool_calls(st).collect())
    assert got == [("q1", "1a", "ra", True), ("q2", "1b", "rb", True), ("q3", "2", None, False)]


def test_second_dialect(spark):
    st = steps(
        spark,
        '{"role":"user","content":[{"type":"text","text":"hi"},{"text":"there"}]}',
        '{"type":"reasoning","summary":[{"text":"why"}]}',
        '{"type":"function_call","call_id":"x","name":"run","arguments":"{}"}',
        '{"type":"function_call_output","call_id":"x","output":"42"}',
        '{"type":"message","role":"assistant","content":"FINAL_SQL: select 1"}',
        '{"role":"assistant","content":"ignored here"}',
    )
    got = [(r["kind"], r["text"]) for r in st.orderBy("seq", "part").collect()]
    assert got == [("user", "hi\nthere"), ("thinking", "why"), ("tool_call", None), ("tool_result", "42"), ("final", "FINAL_SQL: select 1")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("<thinking>X, Y, Z, Q</thinking><GUESS> a, b ,C,d </GUESS>", ["A", "B", "C", "D"]),
        ("I pick ONE, TWO, THREE, FOUR now", ["ONE", "TWO", "THREE", "FOUR"]),
        ("one, two", ["ONE", "TWO"]),
        ("<thinking>never closed A, B, C, D", []),
    ],
)
def test_guess_words(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(J.guess_words(F.col("t"))).collect()[0][0] == want


def test_json_block(spark):
    texts = [
        'ok ```json\n{"verdict":"A","confidence":"HIGH","reasoning":"{x}","recommendation":"R"}\n```',
        'see {"verdict":"B","extra":{"k":{"z":1}}} done',
        "```json\nbroken\n``` then {\"verdict\":\"C\"}",
        "nothing",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["verdict"] for r in J.extract_json_block(df, "t").orderBy("i").collect()] == ["A", "B", "C", "UNCLEAR"]


@pytest.mark.parametrize("block", [3, 1000])
def test_topk_against_brute_force(spark, block):
    import numpy as np

    rnd = np.random.default_rng(1)
    q, t = rnd.normal(size=(15, 8)), rnd.normal(size=(40, 8))
    qs = spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(q)], "question_id int, db_id int, vector array<double>")
    ts = spark.createDataFrame([(i, 0 if i < 37 else 1, [float(x) for x in v]) for i, v in enumerate(t)], "table_id int, db_id int, vector array<double>")
    got = {}
    for r in J.link_tables_topk(qs, ts, k=4, block=block).orderBy("rank").collect():
        got.setdefault(r["question_id"], []).append(r["table_id"])
    for i, v in enumerate(q):
        ids = [j for j in range(40) if (0 if j < 37 else 1) == i % 2]
        best = sorted(ids, key=lambda j: -(v @ t[j]) / np.linalg.norm(v) / np.linalg.norm(t[j]))[:4]
        assert got[i] == best


def test_vectors_are_copied_per_block_of_a_task_not_per_slice(spark):
    """``block`` is what is multiplied at once: 30 vectors in slices of three stay one copy each, and slices keep ties in order."""
    qs = spark.createDataFrame([(i, 0, [1.0, float(i % 3)]) for i in range(30)], "question_id int, db_id int, vector array<double>")
    ts = spark.createDataFrame([(100 - i, 0, [1.0, float(i % 3)]) for i in range(30)], "table_id int, db_id int, vector array<double>")
    left, right = J._block_pairs(qs, ts, J.DEALT)
    assert (left.count(), right.count()) == (30, 30)
    small, large = (sorted(map(tuple, J.link_tables_topk(qs, ts, k=4, block=b).collect())) for b in (3, 1000))
    assert small == large and [r[1] for r in small[:4]] == [73, 76, 79, 82]
