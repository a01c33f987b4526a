"""Ordered computations over sort ranges against plain Python, with one range, some, and more ranges than rows of a key."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.plans import keyed, sequence


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(7)
    rows = []
    for key in ("a", "b", None):
        for pos in range(40 if key == "a" else 7):
            rows.append((key, pos * rnd.randint(1, 3) + pos, rnd.randint(0, 5), f"{key}{pos}"))
    return rows


def grouped(data):
    out = {}
    for row in data:
        out.setdefault(row[0], []).append(row)
    return {k: sorted(v, key=lambda r: (r[1], r[3])) for k, v in out.items()}


SCHEMA = "k string, pos bigint, v int, id string"


@pytest.fixture(params=[1, 4, 60])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_sums(spark, data, parts):
    df = spark.createDataFrame(data, SCHEMA)
    got = sequence.running_sums(df, ["k"], ["pos", "id"], {"s": F.col("v")})
    want = {}
    for rows in grouped(data).values():
        total = 0
        for r in rows:
            total += r[2]
            want[r[3]] = total
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_previous_values(spark, data, parts):
    df = spark.createDataFrame(data, SCHEMA)
    got = sequence.previous_values(df, ["k"], ["pos", "id"], {"v": "before"})
    want = {}
    for rows in grouped(data).values():
        for before, r in zip([None, *rows], rows):
            want[r[3]] = before and before[2]
    assert {r["id"]: r["before"] for r in got.collect()} == want


def test_rank_rows(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    got = sequence.rank_rows(df, ["k"], ["v", "id"])
    want = {}
    for rows in grouped(data).values():
        for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[3])), start=1):
            want[r[3]] = n
    assert {r["id"]: r["rank"] for r in got.collect()} == want


def test_latest_per_key_nulls_lose(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3), (None, 1, 4)], "k string, t int, v int")
    got = {(r["k"], r["t"], r["v"]) for r in keyed.latest_per_key(df, ["k"], ["t"]).collect()}
    assert got == {("a", 5, 2), ("b", None, 3), (None, 1, 4)}


def test_one_position_is_split(spark):
    """Rows of one key that share their position fall into several ranges, and sums and links stay whole."""
    df = spark.range(4000).selectExpr("'a' as k", "cast(7 as bigint) as pos", "cast(1 as int) as v", "id")
    ranges = sequence.in_ranges(df, ["k"], ["pos"]).groupBy("_range").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 3000
    sums = sequence.running_sums(df, ["k"], ["pos"], {"s": F.col("v")}).collect()
    assert sorted(r["s"] for r in sums) == list(range(1, 4001))
    chained = sequence.previous_values(df, ["k"], ["pos"], {"id": "before"}).collect()
    befores = [r["before"] for r in chained]
    assert befores.count(None) == 1 and len(set(befores)) == 4000


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sequence.running_sums(df, ["k"], ["pos"], {"s": F.col("v")}).count() == 0
    assert sequence.previous_values(df, ["k"], ["pos"], {"v": "before"}).count() == 0
    assert sequence.exact_medians(df, ["k"], {"m": F.col("v")}).count() == 0


def test_exact_medians(spark, parts):
    import statistics

    rnd = random.Random(3)
    # large groups with many equal values, also of even length
    data = [(k, float(rnd.choice([1, 2, 3, 50, 51, 99]) + rnd.randint(0, n // 900))) for k, n in (("a", 3001), ("b", 4000)) for _ in range(n)]
    data += [("c", 1.0), ("c", 4.0), ("d", None), (None, 2.0), (None, -3.0), ("e", 8.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: (r["m"], r["n"]) for r in sequence.exact_medians(df, ["k"], {"m": F.col("v"), "n": -F.col("v")}).collect()}
    for key in ("a", "b", "c", None, "e"):
        want = statistics.median(v for k, v in data if k == key)
        assert got[key] == (want, -want)
    assert "d" not in got
