import random
import re

import pytest
from pyspark.sql import functions as F

from evalspark.operators import facts as FA
from evalspark.operators import profile as E
from evalspark.operators import querylog as Q


def log(spark, *statements):
    rows = [(f"{i:04d}", s, "u", f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}") for i, s in enumerate(statements)]
    return spark.createDataFrame(rows, "query_id string, query_text string, user_name string, t string").withColumn("start_time", F.to_timestamp("t"))


def test_joins(spark):
    df = log(
        spark,
        "SELECT * FROM orders o JOIN customers c ON o.customer_id = c.id",
        "select *  from customers AS c\njoin orders AS o on c.id = o.customer_id",
        "SELECT * FROM a JOIN a2 ON a.x = a2.y WHERE a.z = 'a.x = b.y'",
        "not sql at all",
        "WITH x AS (SELECT * FROM t) SELECT * FROM x JOIN t ON x.id = t.id",
    )
    got = {tuple(r) for r in Q.mine_joins(df).collect()}
    assert got == {("customers", "id", "orders", "customer_id", 2), ("a", "x", "a2", "y", 1)}


def test_field_usage(spark):
    df = log(spark, "SELECT u.a, u.b FROM users u JOIN t ON u.id = t.uid WHERE u.a > 0.5 GROUP BY u.a ORDER BY u.b")
    got = {(r["table"], r["column"]): r for r in Q.mine_field_usage(df).collect()}
    a = got[("users", "a")]
    assert (a["select_count"], a["where_count"], a["group_by_count"], a["total_count"], a["importance_score"]) == (1, 1, 1, 3, 5)
    assert got[("users", "id")]["join_count"] == 1 and got[("t", "uid")]["importance_score"] == 3
    assert got[("users", "b")]["order_by_count"] == 1


def test_predicates(spark):
    df = log(
        spark,
        "SELECT 1 FROM t WHERE t.a = 5 AND t.b = 'short' AND t.c LIKE '%a very long pattern indeed%' AND t.d IN (1, 2) AND t.e BETWEEN 3 AND 4 AND t.f IS NOT NULL AND t.g IS NULL",
        "SELECT 1 FROM t WHERE t.a = 7",
    )
    got = {(r["column"], r["operator"], r["value_pattern"]): (r["occurrence_count"], r["example_values"]) for r in Q.mine_predicates(df).collect()}
    assert got[("a", "=", "<number>")] == (2, ["5", "7"])
    assert got[("b", "=", "'short'")] == (1, ["'short'"])
    assert set(got) >= {("c", "LIKE", "'<string>'"), ("d", "IN", "<number>"), ("e", "BETWEEN", "<number>"), ("f", "IS NOT NULL", "NULL"), ("g", "IS NULL", "NULL")}


def test_intra_constraints(spark):
    df = log(spark, "SELECT 1 FROM t x WHERE x.a < x.b", "SELECT 1 FROM t WHERE t.b = t.a", "SELECT 1 FROM t WHERE t.a = t.b")
    got = {tuple(r) for r in Q.mine_intra_constraints(df).collect()}
    assert got == {("t", "a", "<", "b", 1), ("t", "a", "=", "b", 2)}


def test_ctes_and_derived(spark):
    df = log(spark, "WITH s AS (SELECT o.k, SUM(o.v) AS total FROM orders o GROUP BY o.k), p AS (SELECT q.z FROM q) SELECT s.total * 2 AS twice FROM s")
    got = {r["cte_name"]: (r["tables"], r["has_aggregation"]) for r in Q.mine_ctes(df).collect()}
    assert got["s"] == (["orders"], True)
    derived = {r["alias"]: (r["expression"], r["contexts"]) for r in Q.mine_derived_columns(df).collect()}
    assert derived == {"total": ("SUM(o.v)", ["CTE"]), "twice": ("s.total * 2", ["SELECT"])}


def test_nested_expressions(spark):
    df = log(
        spark,
        "SELECT o.quantity * o.price as total FROM orders o",
        "SELECT sum(COALESCE(o.x, 0)) AS s, ROUND(AVG(o.y), 2) AS m, CASE WHEN o.z > 1 THEN 'a, b' ELSE 'c' END AS lvl FROM orders o",
        "SELECT unit_price * quantity * (1 - discount) as line_total FROM order_details",
        "SELECT u.name, u.id FROM users u",
        "BAD SQL",
    )
    metrics = {r["expression"]: (r["aliases"], r["tables"]) for r in Q.mine_metrics(df).collect()}
    assert metrics == {
        "o.quantity * o.price": (["total"], ["orders"]), "SUM(COALESCE(o.x, 0))": (["s"], ["orders"]), "ROUND(AVG(o.y), 2)": (["m"], ["orders"]),
        "unit_price * quantity * (1 - discount)": (["line_total"], []),
    }
    derived = {r["alias"]: r["expression"] for r in Q.mine_derived_columns(df).collect()}
    assert derived == {
        "total": "o.quantity * o.price", "s": "SUM(COALESCE(o.x, 0))", "m": "ROUND(AVG(o.y), 2)", "lvl": "CASE WHEN o.z > 1 THEN 'a, b' ELSE 'c' END",
        "line_total": "unit_price * quantity * (1 - discount)",
    }
    long = log(spark, "SELECT SUM(" + " + ".join(f"o.c{i}" for i in range(300)) + ") AS s FROM orders o")
    assert Q.mine_metrics(long).count() == 1 and Q.mine_metrics(long, max_chars=100).count() == 0


def test_every_cte(spark):
    df = log(
        spark,
        "WITH a AS (SELECT x.k FROM x), b AS (SELECT COUNT(y.v) AS n FROM y WHERE y.t = ')') SELECT * FROM a JOIN b ON a.k = b.n",
        "WITH customers_filtered AS (SELECT * FROM customers WHERE active = true), orders_recent AS (SELECT * FROM orders WHERE order_date > '2024-01-01') SELECT * FROM customers_filtered c",
        "NOT VALID SQL",
    )
    got = {r["cte_name"]: (r["definition"], r["tables"], r["has_aggregation"]) for r in Q.mine_ctes(df).collect()}
    assert got == {
        "a": ("SELECT x.k FROM x", ["x"], False), "b": ("SELECT COUNT(y.v) AS n FROM y WHERE y.t = ')'", ["y"], True),
        "customers_filtered": ("SELECT * FROM customers WHERE active = true", ["customers"], False),
        "orders_recent": ("SELECT * FROM orders WHERE order_date > '2024-01-01'", ["orders"], False),
    }
    assert {r["definition"] for r in Q.mine_ctes(df, max_chars=6).collect()} == {"SELECT..."}


def test_quoted_predicates(spark):
    df = log(spark, "SELECT 1 FROM orders o WHERE o.s = 'it''s' AND o.k = (SELECT MAX(i.k) FROM items i) AND o.g IN ('a,b', 'c')")
    got = {(r["column"], r["operator"], r["value_pattern"]): r["example_values"] for r in Q.mine_predicates(df).collect()}
    assert got == {("s", "=", "'it''s'"): ["'it''s'"], ("g", "IN", "'a,b'"): ["('a,b', 'c')"]}


def greedy(queries):
    """Frequency-first walk that keeps whatever adds something new."""
    seen, kept = set(), []
    for text, n, features in sorted(queries, key=lambda q: (-q[1], q[0])):
        if not kept or features - seen:
            kept.append(text)
            seen |= features
    return kept[:30]


def test_diverse_samples_equal_greedy(spark):
    rnd = random.Random(2)
    statements = []
    for _ in range(60):
        t, g = rnd.choice("abcd"), rnd.choice("xyz")
        agg = rnd.choice(["SUM", "AVG", "COUNT"])
        statements.append(rnd.choice([f"SELECT {t}.{g} FROM {t}", f"SELECT {agg}({t}.v) AS n FROM {t} GROUP BY {t}.{g}", f"SELECT {t}.v + 1 AS m FROM {t} JOIN b ON {t}.i = b.i"]))
    df = log(spark, *statements)
    sigs = [
        (r["cleaned"], r["frequency"], {"t:" + ",".join(r["tables"])} | {"a:" + x for x in r["aggregates"]} | {"g:" + x for x in r["group_by_columns"]} | {"e:" + x for x in r["expressions"]})
        for r in Q.query_signature(df).collect()
    ]
    assert [r["query"] for r in Q.diverse_samples(df).collect()] == greedy(sigs)


GUARD = [
    ("SELECT 1", True), ("  with x as (select 1) select * from x;", True), ("select 1; select 2", False), ("EXPLAIN ANALYZE SELECT 1", False),
    ("SELECT * FROM t WHERE x = 'drop'", False), ("insert into t values (1)", False), ("", False), (None, False), ("describe t", True), ("updated_at", False),
    ("select updated_at from t", True),
]


def test_read_only_guard(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(GUARD)], "i int, query_text string")
    assert [r["is_read_only"] for r in Q.read_only_guard(df).orderBy("i").collect()] == [w for _, w in GUARD]


CROSS = [
    ("select * from mine.main.t", None), ("SELECT * FROM mine.main.t JOIN other.main.s ON 1=1", "cross-database other"), ("USE\nother", "USE"), ("attach 'x'", "ATTACH"),
    ('select * from "Other".main.t', "cross-database other"), ("drop schema if exists other", "DROP DATABASE"), ("drop database mine", None), ("select a.b from t a", None),
]


def test_cross_database(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CROSS)], "i int, query_text string")
    assert [r["reason"] for r in Q.cross_database_audit(df, "mine").orderBy("i").collect()] == [w for _, w in CROSS]


# ---- profile


def test_patterns(spark):
    samples = [["a@b.co", "c@d.org"], ["https://x", "http://y"], ["12345678-1234-1234-1234-1234567890ab"], ["2024-01-02", "03/04/2024", "01-02-03", "2024/01/01", "x"], ["+1 555 1234"], ["abc"], [], [None]]
    tables = {f"t{i}": spark.createDataFrame([(v,) for v in vs], "s string") for i, vs in enumerate(samples)}
    got = {r["table"]: r["detected_pattern"] for r in E.column_statistics(tables).collect()}
    assert [got[f"t{i}"] for i in range(len(samples))] == ["email", "url", "uuid", "date_string", "phone", None, None, None]


def test_whole_column_decides(spark):
    """Values beyond the smallest ones count: neither 20 e-mails first nor 5 midnights first name a column."""
    mixed = [f"a{i:02d}@b.co" for i in range(20)] + [f"word {i}" for i in range(20)]
    mails = ["#"] * 2 + [f"u{i}@b.co" for i in range(8)]
    times = [f"2024-01-{i:02d} 00:00:00" for i in range(1, 10)]
    tables = {
        "mixed": spark.createDataFrame([(v,) for v in mixed], "s string"),
        "mails": spark.createDataFrame([(v,) for v in mails], "s string"),
        "days": spark.createDataFrame([(v,) for v in times], "s string").selectExpr("timestamp(s) as s"),
        "late": spark.createDataFrame([(v,) for v in times + ["2024-02-01 00:30:00"]], "s string").selectExpr("timestamp(s) as s"),
        "fine": spark.createDataFrame([(v,) for v in times + ["2024-02-01 00:00:00.5"]], "s string").selectExpr("timestamp(s) as s"),
        "none": spark.createDataFrame([(None,)], "s timestamp"),
        "date": spark.createDataFrame([("2024-01-01",)], "s string").selectExpr("date(s) as s"),
    }
    stats = FA.date_granularity(E.column_statistics(tables))
    got = {r["table"]: (r["detected_pattern"], r["date_granularity"]) for r in stats.collect()}
    assert got == {
        "mixed": (None, None), "mails": ("email", None), "days": (None, "day"), "late": (None, "minute"), "fine": (None, "second"),
        "none": (None, "day"), "date": (None, "day"),
    }


def test_smallest_values(spark):
    """The smallest distinct values over many tasks, in byte order, without NULLs."""
    rnd = random.Random(8)
    words = [rnd.choice(["", "a", "Z", "\u00e9", "\U0001f600", "zz"]) + str(rnd.randint(0, 60)) for _ in range(900)] + [None] * 9
    df = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)], "w string, c int").repartition(7)
    got = {r["column"]: r["sample_values"] for r in E.sample_values(E.smallest_values({"t": df}, 20)).collect()}
    assert got["w"] == sorted({w for w in words if w is not None}, key=lambda w: w.encode())[:20]
    assert got["c"] == ["0", "1", "2"]
    assert E.smallest_values({"t": df.limit(0)}).count() == 0


@pytest.fixture(scope="module")
def pair(spark):
    left = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(200)], "team_id int, code int, name string")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(50, 260)] + [(None, None)], "team_id int, label string")
    return {"left": left, "right": right}


def test_exact_and_estimated_similarity(pair):
    values = E.column_values(pair)
    exact = {(r["source_column"], r["target_column"]): r["jaccard_similarity"] for r in E.column_jaccard_exact(values).collect()}
    assert exact[("team_id", "team_id")] == round(150 / 260, 3)
    guess = {(r["source_column"], r["target_column"]): r["jaccard_similarity"] for r in E.column_similarity(E.minhash_signature(values), 0.3).collect()}
    assert abs(guess[("team_id", "team_id")] - exact[("team_id", "team_id")]) < 0.1
    assert abs(guess[("name", "label")] - exact[("name", "label")]) < 0.1


def test_similarity_bands_lose_no_pair(spark):
    """Against all pairs of signatures, and at least nine in ten of the pairs that exact counts put at 0.5 or more."""
    step = lambda i: spark.range(i * 40, i * 40 + 300).selectExpr("id as v", "id % 7 as w", "cast(null as string) as n")
    tables = {f"t{i}": step(i) for i in range(6)}
    values = E.column_values(tables)
    signatures = E.minhash_signature(values)
    rows = [(r["table"], r["column"], r["signature"]) for r in signatures.collect()]
    key = lambda r: (r["source_table"], r["source_column"], r["target_table"], r["target_column"])
    got = {key(r): r["jaccard_similarity"] for r in E.column_similarity(signatures).collect()}
    every = {
        (a, c, b, d): round(sum(x == y for x, y in zip(s, t)) / len(s), 3) for a, c, s in rows for b, d, t in rows if a < b
    }
    assert got == {k: v for k, v in every.items() if v >= 0.5}
    exact = {key(r) for r in E.column_jaccard_exact(values).collect() if r["jaccard_similarity"] >= 0.5}
    assert len(exact) >= 20 and len(exact & set(got)) >= 0.9 * len(exact)


def test_orphans_both_ways(pair):
    got = {(r["table"], r["column"]): (r["orphan_count"], len(r["orphan_sample"])) for r in E.orphan_values(E.column_values(pair)).collect()}
    assert got == {("left", "team_id"): (50, 10), ("right", "team_id"): (60, 10)}


def test_profile_flags(pair):
    got = {(r["table"], r["column"]): r for r in E.profile_columns(pair, exact=True).collect()}
    code, team = got[("left", "code")], got[("left", "team_id")]
    assert not code["is_categorical"] and code["unique_count"] == 3  # contiguous from zero
    assert got[("right", "label")]["null_percentage"] == pytest.approx(100 / 211)
    keyed = {(r["table"], r["column"]): r["is_primary_key"] for r in FA.detect_primary_key(E.profile_columns(pair, exact=True)).collect()}
    assert keyed[("left", "team_id")] and keyed[("right", "team_id")] and not keyed[("left", "name")]
    assert team["avg"] == pytest.approx(99.5)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, name string")
    got = {r["column"]: (r["unique_count"], r["count"]) for r in E.profile_columns({"t": empty}, exact=False).collect()}
    assert got == {"id": (0, 0), "name": (0, 0)}


def test_orphans_join_no_column_in_one_task(spark):
    """Values meet the pairs of columns where they are, also when Spark does not expect the pairs to be few."""
    values = spark.createDataFrame(
        [("a", "a_id", "1"), ("a", "a_id", "2"), ("a", "a_id", None), ("b", "b_id", "2"), ("b", "b_id", "3"), ("b", "b_own", "9")], "`table` string, `column` string, value string"
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = E.orphan_values(values, prefix="^[a-z]_")
        plan = found._jdf.queryExecution().toString()
        rows = sorted((r["table"], r["other_table"], r["orphan_count"], r["orphan_sample"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == [("a", "b", 1, ["1"]), ("b", "a", 1, ["3"])]
    assert "BroadcastHashJoin [table" in plan and not re.search(r"SortMergeJoin \[table#\d+, column#\d+\], \[table", plan)


def test_orphans_need_the_values_of_namesakes_only(spark, rows):
    tables = {
        "one": spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5), (None, "c", None)], "o_Key long, text string, price double"),
        "two": spark.createDataFrame([(2, "b", "x"), (3, None, "y")], "t_key long, TEXT string, other string"),
        "three": spark.createDataFrame([(7,)], "alone int"),
    }
    names = E.namesakes(tables, "^[a-z]_")
    assert names == {"one": ["o_Key", "text"], "two": ["t_key", "TEXT"], "three": []}
    found = E.orphan_values(E.column_values(tables, columns=names), prefix="^[a-z]_")
    assert rows(found) == rows(E.orphan_values(E.column_values(tables), prefix="^[a-z]_")) and found.count() == 3
    assert E.namesakes(tables) == {"one": ["text"], "two": ["TEXT"], "three": []}
    alone = {"three": tables["three"]}
    assert E.column_values(alone, columns=E.namesakes(alone)).count() == 0


def test_facts_gather_distinct_values_once(spark, monkeypatch):
    from evalspark.catalog import profile as CP
    from evalspark.catalog.inputs import Inputs

    asked = []

    def counted(tables, key_length=None, columns=None, gather=E.column_values):
        asked.append((key_length, columns is None))
        return gather(tables, key_length, columns)

    monkeypatch.setattr(E, "column_values", counted)
    monkeypatch.setattr(CP, "RAW_TABLES", ("nation", "region"))
    t = Inputs(spark, "nowhere")
    t._built["region"] = spark.createDataFrame([(0, "A"), (1, "B")], "r_regionkey int, r_name string")
    t._built["nation"] = spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int")
    events = spark.createDataFrame([(i, "2026-01-01 00:00:00", i % 3, "view", 1.5) for i in range(40)], "event_id long, ts string, user_id long, event_type string, value double")
    t._built["events"] = events.withColumn("ts", F.to_timestamp("ts"))
    assert CP._facts(t).count() == 5
    assert sorted(asked, key=str) == [(64, True), (None, False)]
