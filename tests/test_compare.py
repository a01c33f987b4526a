"""Verdicts per branch, and tolerant matching against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions import cells as X
from evalspark.operators import compare as G

CASES = {
    "reordered": ([["1", "a"], ["2", "b"]], [["2", "B "], ["1.0", "a"]], ("correct", None)),
    "integral": ([["118.0"]], [["118"]], ("correct", None)),
    "truth": ([["yes"]], [["True"]], ("correct", None)),
    "rounded": ([["24.67"]], [["24.6666667"]], ("correct", None)),
    "missing_column": ([["1", "x"], ["2", "y"]], [["1"], ["2"]], ("partial", "missing_columns:1")),
    "extra_column": ([["1"], ["2"]], [["2", "z"], ["1", "z"]], ("partial", "extra_columns:1")),
    "aggregated": ([["YES"], ["YES"], ["yes"]], [["1"]], ("partial", "aggregated_equivalent:3_to_1")),
    "distinct": ([["a"], ["a"], ["b"]], [["b"], ["a"]], ("partial", "implicit_distinct:1_duplicates_removed")),
    "duplicates": ([["a"], ["b"]], [["a"], ["b"], ["b"], ["b"]], ("partial", "extra_duplicates:2_duplicates_in_predicted")),
    "missing_rows": ([["a"], ["b"], ["c"]], [["a"], ["c"]], ("incorrect", "missing_rows:1")),
    "missing_rows_close": ([["10.0"], ["20.0"], ["30.0"]], [["20.0001"], ["30.0"]], ("incorrect", "missing_rows:1")),
    "extra_rows": ([["a"], ["b"]], [["a"], ["b"], ["c"]], ("partial", "extra_rows:1")),
    "close": ([["100"]], [["104"]], ("partial", "values_close_not_exact")),
    "not_close": ([["100"]], [["106"]], ("incorrect", None)),
    "truth_is_no_number": ([["yes"]], [["1.04"]], ("incorrect", None)),
    "both_empty": ([], [], ("correct", None)),
    "one_empty": ([["a"]], [], ("incorrect", "empty_result")),
    "nulls": ([[None, "1"]], [[None, "1.0"]], ("correct", None)),
    "null_is_not_zero": ([[None]], [["0"]], ("incorrect", None)),
    "long_ids": ([["12345678901234567"], ["1"]], [["12345678901234568"], ["2"]], ("incorrect", None)),
    "noisy_pair": ([["1", "0.5"], ["2", "0.7"]], [["2", "0.70001"], ["1", "0.49999"]], ("correct", None)),
}


def frame(spark, cases):
    rows = [
        (name, side, i, row)
        for name, (gold, pred, *_rest) in cases.items()
        for side, table in (("gold", gold), ("pred", pred))
        for i, row in enumerate(table)
    ]
    results = spark.createDataFrame(rows, "case_id string, side string, row_no bigint, cells array<string>")
    heads = spark.createDataFrame([(n, None, None) for n in cases], "case_id string, gold_error string, pred_error string")
    return results, heads


def test_every_branch(spark):
    got = {r["case_id"]: (r["level"], r["reason"]) for r in G.compare_results(*frame(spark, CASES)).collect()}
    assert got == {name: want for name, (_, _, want) in CASES.items()}


def test_errors(spark):
    results, _ = frame(spark, {"a": ([["1"]], [["1"]])})
    heads = spark.createDataFrame([("a", None, "ERROR: x"), ("b", "ERROR", "ERROR")], "case_id string, gold_error string, pred_error string")
    got = {r["case_id"]: (r["level"], r["reason"]) for r in G.compare_results(results, heads).collect()}
    assert got == {"a": ("error", "predicted_query_error"), "b": ("error", "gold_query_error")}


def test_fallback(spark):
    cases = {k: CASES[k] for k in ("reordered", "not_close", "one_empty")}
    results, heads = frame(spark, cases)
    second = spark.createDataFrame([("not_close", 0, ["106.0"]), ("one_empty", 0, ["a"])], "case_id string, row_no bigint, cells array<string>")
    got = {r["case_id"]: (r["level"], r["reason"], r["match_source"]) for r in G.compare_with_fallback(results, heads, second).collect()}
    assert got == {
        "reordered": ("correct", None, "gold"),
        "not_close": ("correct", "platinum_match", "platinum"),
        "one_empty": ("incorrect", "empty_result", "none"),
    }


def python_equal(gold, pred):
    if gold == pred:
        return True
    if gold.isalpha() or pred.isalpha():
        return False
    places = len(gold.split(".")[1].rstrip("0")) if "." in gold else 0
    g, p = float(gold), float(pred)
    if 0 in (g, p):
        return round(g, places) == round(p, places) or abs(g - p) < 1e-4
    return round(g, places) == round(p, places) or abs(g - p) / max(abs(g), abs(p)) < 1e-4


def brute_force(gold, pred):
    """Greedy one-to-one matching in row order."""
    left = list(pred)
    if len(gold) != len(pred):
        return False
    for row in gold:
        hit = next((c for c in left if all(python_equal(a, b) for a, b in zip(row, c))), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def test_bag_match_against_brute_force(spark):
    rnd = random.Random(11)
    cases = {}
    for n in range(80):
        gold = [[str(rnd.randint(1, 9)), f"{rnd.uniform(1, 500):.3f}"] for _ in range(rnd.randint(1, 8))]
        pred = [[a, repr(float(b) * (1 + rnd.choice([0, 0, 4e-5, -4e-5, 3e-3 if n % 4 == 0 else 0])))] for a, b in gold]
        rnd.shuffle(pred)
        cases[f"c{n}"] = (gold, pred)
    results, _ = frame(spark, cases)
    got = {r["case_id"]: r["matches"] for r in G.results_match_bag(results).collect()}
    assert got == {name: brute_force(*pair) for name, pair in cases.items()}
    assert 10 < sum(got.values()) < 80


def test_several_inexact_columns(spark):
    cases = {
        "crossed": ([["100.001", "5.5"], ["100.002", "9.5"]], [["100.003", "5.5"], ["100.0015", "9.5"]]),
        "extra": ([["100.003", "5.5"]], [["100.001", "5.5"], ["100.002", "9.5"], ["200.5", "1.5"]]),
        "missing": ([["100.001", "5.5"], ["100.002", "9.5"], ["200.5", "1.5"]], [["100.003", "5.5"]]),
    }
    results, heads = frame(spark, cases)
    got = {r["case_id"]: (r["level"], r["reason"]) for r in G.compare_results(results, heads).collect()}
    assert got == {"crossed": ("correct", None), "extra": ("partial", "extra_rows:2"), "missing": ("incorrect", "missing_rows:2")}


@pytest.mark.parametrize("inexact", [2, 3])
def test_inexact_columns_against_brute_force(spark, inexact):
    rnd = random.Random(inexact)
    cases = {}
    for n in range(120):
        gold = [
            [rnd.choice(["a", "b"]), str(rnd.randint(0, 3)), *[f"{rnd.choice([0.0, 2.5, 40, 41, 800]) + rnd.uniform(0, 0.01):.{rnd.randint(0, 4)}f}" for _ in range(inexact)]]
            for _ in range(rnd.randint(1, 9))
        ]
        change = lambda x: repr(float(x) * (1 + rnd.choice([0, 0, 3e-5, -3e-5, 8e-5, 2e-3 if n % 3 == 0 else 0])))  # noqa: B023, E731
        pred = [[*r[:2], *map(change, r[2:])] for r in gold]
        rnd.shuffle(pred)
        extra = rnd.randint(0, 2) if n % 2 else 0
        cases[f"c{n}"] = (gold, pred + pred[:extra]) if n % 4 == 1 else (gold + gold[:extra], pred)
    results, heads = frame(spark, cases)
    bag = {r["case_id"]: r["matches"] for r in G.results_match_bag(results).collect()}
    assert bag == {name: brute_force(*pair) for name, pair in cases.items()}
    assert 10 < sum(bag.values()) < 110
    rows = {r["case_id"]: r["reason"] for r in G.check_rows(results).collect()}

    def contained(few, many):
        return all(any(all(python_equal(x, y) for x, y in zip(a, b)) for b in many) for a in few)

    want = {}
    for name, (gold, pred) in cases.items():
        if len(gold) > len(pred) and contained(pred, gold):
            want[name] = f"missing_rows:{len(gold) - len(pred)}"
        if len(gold) < len(pred) and contained(gold, pred):
            want[name] = f"extra_rows:{len(pred) - len(gold)}"
    assert rows == want and want


def test_long_case(spark):
    """One case with most of the rows."""
    gold = [[str(i), f"{i}.25"] for i in range(400)]
    pred = [[str(i), f"{i * (1 + 1e-5) + 0.25:.6f}"] for i in reversed(range(400))]
    results, heads = frame(spark, {"big": (gold, pred), "small": ([["1"]], [["1"]]), "wide": (gold, [[*r, "x"] for r in gold])})
    got = {r["case_id"]: (r["level"], r["reason"]) for r in G.compare_results(results, heads).collect()}
    assert got == {"big": ("correct", None), "small": ("correct", None), "wide": ("partial", "extra_columns:1")}


def test_decimal_places(spark):
    df = spark.createDataFrame([("24.60",), ("118",), ("1.",), ("abc",), (None,), ("0.125",)], "v string")
    assert [r[0] for r in df.select(X.decimal_places(F.col("v"))).collect()] == [1, 0, 0, None, None, 3]


def test_python_float_text(spark):
    values = [1.0, 0.5, 1e7, 123456789.25, 1e15, 0.0001, -2.5e8, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(X.python_float_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_parse_result_text(spark):
    texts = {
        "lines": "['a', 1]\n['b', None]\nnonsense\n... (sampled 2 of 9 total rows)",
        "nested": "[['a'], ['b']]",
        "flat": "[203.8]",
    }
    df = spark.createDataFrame(list(texts.items()), "case_id string, result_text string")
    got = {}
    for r in G.parse_result_text(df).orderBy("row_no").collect():
        got.setdefault(r["case_id"], []).append(r["cells"])
    assert got == {"lines": [["a", "1"], ["b", None]], "nested": [["a"], ["b"]], "flat": [["203.8"]]}


def sequential(edges):
    """Gold rows in order, each taking its first predicted rows that are left."""
    left = {(c, b): n for c, _, b, _, n in edges}
    paired = {}
    for c, a in sorted({(e[0], e[1]) for e in edges}):
        own = sorted((e[2], e[3]) for e in edges if e[0] == c and e[1] == a)
        need = own[0][1]
        for b, _ in own:
            taken = min(need, left[c, b])
            left[c, b] -= taken
            need -= taken
            paired[c] = paired.get(c, 0) + taken
    return paired


def test_rounds_equal_one_after_the_other(spark):
    rnd = random.Random(11)
    edges = []
    for case in range(40):
        n = rnd.randint(1, 7)
        times = [[rnd.choice([1, 1, 2, 3]) for _ in range(n)] for _ in "ab"]
        edges += [(f"c{case}", a, b, times[0][a], times[1][b]) for a in range(n) for b in range(n) if rnd.random() < 0.45]
    # half of all rows in one case: all near each other, and a chain in which each row waits for the one before
    edges += [("dense", a, b, 1, 1) for a in range(30) for b in range(25)]
    edges += [("chain", a, b, 1, 1) for a in range(6) for b in (a, a + 1)]
    df = spark.createDataFrame(edges, "case_id string, a_no long, b_no long, a_times long, b_times long")
    found = {r["case_id"]: r["paired"] for r in G._pair_greedily(df).collect()}
    assert found == sequential(edges) and found["dense"] == 25
    assert G._pair_greedily(df.where("false")).count() == 0


def test_result_rows_are_read_once_and_meet_their_cases_once(spark, rows):
    """One pass over the lines gives the rows of the union that the check reads; nothing but the lines is shuffled before distinct rows."""
    from evalspark.catalog import inputs as I

    lines = [(k, k % 7 + i, i % 3, i % 2, float(i % 5), 10.0 * i + k / 100, "R" if i % 2 else None) for k in range(30) for i in range(k % 6 + 1)]
    lines += lines[40:60] + [(None, 1, 2, 3, 4.0, 5.0, "N")]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    t = I.Inputs(spark, "nowhere")
    t._built["lineitem"] = spark.createDataFrame(lines, schema)
    base = spark.sql(I._dialect(I.INPUTS["result_base"][1], 0), lineitem=t.lineitem)
    union = spark.sql(I._dialect(I.INPUTS["result_cells"][1], 0), result_base=base)
    assert rows(t.result_cells) == rows(union)
    assert t.result_cells.dtypes == union.dtypes
    plan = G._distinct_rows(G.normalized(t.result_cells))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_values_at_the_edges_of_buckets_pair(spark):
    from math import exp

    made = []
    for case, place in enumerate([k + d for k in (-700, 3, 4000, 9001) for d in (1e-9, -1e-9, 0.03, -0.03, 0.06, -0.06, 0.5)]):
        v = exp(place * G._BUCKET)
        for sign in (1, -1):
            for factor in (1 - 0.999e-4, 1 + 0.999e-4, 1 - 1.02e-4, 1 + 1.02e-4):
                made.append((len(made) + 1000 * case, sign * v, sign * v * factor, abs(factor - 1) < 1e-4))
    results = [(c, "gold", 1, [f"{a!r}", "x"]) for c, a, _, _ in made] + [(c, "pred", 1, [f"{b!r}", "x"]) for c, _, b, _ in made]
    found = G.results_match_bag(spark.createDataFrame(results, "case_id long, side string, row_no int, cells array<string>"))
    assert {r["case_id"]: r["matches"] for r in found.collect()} == {c: ok for c, _, _, ok in made}
