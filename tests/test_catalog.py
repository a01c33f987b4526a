"""The registry as a whole, and a few queries beside their check SQL on the smallest tables."""

import pathlib
import re
import sys

import pytest

import __spark_entry__ as entry
from evalspark.catalog.inputs import RAW_TABLES

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "total_fees", "merchant_transaction_fees", "list_rule_join", "dedupe_latest", "run_summary", "matrix_transitions",
    "build_postings_task_complete", "task_lifecycle_check", "model_leaderboard", "stratified_split", "model_config_summary",
    "error_types", "compare_results", "format_answer", "score_answer", "mine_predicates", "diverse_samples", "column_jaccard_exact",
    "pair_tool_calls", "link_tables_topk", "stream_sessions",
]


def test_oracles_belong_to_queries():
    names = set(entry.queries())
    assert len(names) > 200
    assert set(entry.oracle_sql()) <= names
    assert len(entry.oracle_sql()) > 0.9 * len(names)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["merchant", "year", "month", "total_fee"] and df.count() > 0


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in RAW_TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_against_check_sql(spark, con, name):
    import check

    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert check.compare(got, con.execute(entry.oracle_sql()[name]).df()).startswith("ok")


def test_library_never_collects_rows():
    for path in (ROOT / "evalspark").rglob("*.py"):
        text = path.read_text()
        found = len(re.findall(r"\.(?:collect|toPandas|toLocalIterator)\(\)", text))
        assert found == 0, path
        assert "localCheckpoint" not in text and "crossJoin" not in text, path


@pytest.mark.parametrize("name", ["merchant_transaction_fees", "total_fees", "run_summary", "mine_joins", "matrix_transitions"])
def test_plans_stay_in_the_engine(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
