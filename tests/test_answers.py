import pytest
from pyspark.sql import functions as F

from evalspark.operators import answers as A

EQUAL = [
    ("IT, FR", "fr,it", True),
    ("['C']", "C", True),
    ("['A', 'B']", "A, B", True),
    ("n/a", "Not Applicable", True),
    ("", "-", True),
    ("5.0", "5", True),
    ("-12.5", "12.5", True),
    ("0.0000000001", "0", True),
    ("12.5", "12.6", False),
    ("Visa: 3", "visa", True),
    ("visa", "Visa;x", True),
    ("visacard", "visa", False),
    ("A, B", "A, C", False),
    ('"yes"', "YES", True),
]


def test_answers_equal(spark):
    df = spark.createDataFrame([(p, g) for p, g, _ in EQUAL], "p string, g string")
    got = [r[0] for r in df.select(A.answers_equal(F.col("p"), F.col("g"))).collect()]
    assert got == [want for _, _, want in EQUAL]


LAYOUT = [
    ("A,B", "A, B", "A, B"),
    ("A, B", "[A, B]", "[A, B]"),
    ("3.14159", "2.71", "3.14"),
    ("3.7", "4", "4"),
    ("[a:1.239, b:2]", "[a: 1.24, b: 2.00]", "[a: 1.24, b: 2.00]"),
    ("it", "IT", "IT"),
    ("true", "yes", "yes"),
    ("A, B, C", "A, B", "A, B, C"),
    ("Not Applicable", "4.00", "Not Applicable"),
    ("5", "x", "5"),
    (None, "x", None),
    ("two words", "Two Words", "two words"),
]


def test_normalize_to_gold_format(spark):
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(LAYOUT)], "i int, p string, g string")
    got = [r["o"] for r in A.normalize_to_gold_format(df, "p", "g", "o").orderBy("i").collect()]
    assert got == [want for _, _, want in LAYOUT]


FORMATS = [
    ([], None, "Not Applicable"),
    ([["5"]], "rounded to 2 decimals", "5.00"),
    ([["IT, FR"]], "comma list", "IT,FR"),
    ([["IT, FR"]], "eg: A, B", "IT, FR"),
    ([["Visa,3.5"]], "{scheme}:{fee}", "Visa:3.5"),
    ([["a", "1.239"], ["b", "2"]], "[grouping_i: amount_i, ] rounded to 2 decimals", "[a: 1.24, b: 2.00]"),
    ([["a: 1.5"], ["b: 2.25"]], "[grouping_i: amount_i, ]", "[a: 1.5, b: 2.25]"),
    ([["a", "b", "c"]], None, "a,b,c"),
    ([["a"], ["b"]], "eg: A, B, C", "a, b"),
    ([["a", "1"], ["b", "2"]], "{k}:{v}", "a:1, b:2"),
    ([["a", "1"], ["b", "2"]], None, "a: 1, b: 2"),
    ([[None]], None, "Not Applicable"),
]


def test_format_answer(spark):
    rows = spark.createDataFrame(
        [(c, i, r) for c, (table, _, _) in enumerate(FORMATS) for i, r in enumerate(table)], "case_id int, row_no int, cells array<string>"
    )
    hints = spark.createDataFrame([(c, g) for c, (_, g, _) in enumerate(FORMATS)], "case_id int, guidelines string")
    got = {r["case_id"]: r["answer"] for r in A.format_answer(rows, hints).collect()}
    assert [got[c] for c in range(len(FORMATS))] == [want for _, _, want in FORMATS]


@pytest.mark.parametrize(
    "row,want",
    [
        (("5", "5", True, False, True), ("hit_limit", 0.0, "hit_limit")),
        ((None, "Not Applicable", False, True, False), ("correct", 1.0, "no_sql_produced")),
        ((None, "7", True, True, False), ("incorrect", 0.0, "sql_execution_error")),
        ((None, "7", False, True, False), ("incorrect", 0.0, "no_sql_produced")),
        (("", "7", True, False, False), ("incorrect", 0.0, "empty_prediction")),
        (("7.004", "7.00", True, False, False), ("correct", 1.0, None)),
        (("8", "7", True, False, False), ("incorrect", 0.0, None)),
    ],
)
def test_score_answer(spark, row, want):
    df = spark.createDataFrame([row], "answer string, gold string, has_sql boolean, failed boolean, hit_limit boolean")
    r = A.score_answer(df).collect()[0]
    assert (r["correctness"], r["score"], r["reason"]) == want


def test_many_decimals(spark):
    df = spark.createDataFrame([(0.00001234, 14), (1.5, 13), (2.345, 2), (1e-5, 5)], "v double, p int")
    assert [r[0] for r in df.select(A.fixed_decimals(F.col("v"), F.col("p"))).collect()] == ["0.00001234000000", "1.5000000000000", "2.34", "0.00001"]
