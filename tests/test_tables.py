"""Loading a star in both layouts and copying tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import types as T

from evalspark.sources import tables as TB

MERCHANTS = [
    {"merchant": "m1", "capture_delay": "immediate", "acquirer": ["a", "b"]},
    {"merchant": "m2", "capture_delay": None, "acquirer": []},
]
SCHEMA = T.StructType().add("merchant", "string").add("capture_delay", "string").add("acquirer", T.ArrayType(T.StringType()))


def _files(folder):
    (folder / "lines.json").write_text("\n".join(map(json.dumps, MERCHANTS)))
    (folder / "array.json").write_text(json.dumps(MERCHANTS, indent=2))
    (folder / "countries.csv").write_text('acquirer,country_code\na,NL\n"b, c",\n')
    return folder


def test_json_lines_and_array_documents_load_alike(spark, tmp_path):
    folder = _files(tmp_path)
    schemas = {"merchant_data": SCHEMA}
    lines = TB.load_star(spark, {"merchant_data": f"{folder}/lines.json"}, schemas)["merchant_data"]
    whole = TB.load_star(spark, {"merchant_data": f"{folder}/array.json"}, schemas, documents=frozenset({"merchant_data"}))["merchant_data"]
    want = [("m1", "immediate", ["a", "b"]), ("m2", None, [])]
    assert sorted(map(tuple, lines.collect())) == want
    assert sorted(map(tuple, whole.collect())) == want


def test_both_layouts_of_the_same_files(spark, tmp_path):
    folder = _files(tmp_path)
    paths = {"acquirer_countries": f"{folder}/countries.csv", "merchant_data": f"{folder}/lines.json"}
    schemas = {"acquirer_countries": T.StructType().add("acquirer", "string").add("country_code", "string"), "merchant_data": SCHEMA}
    named = TB.load_star(spark, paths, schemas, *TB.descriptive_layout())
    assert sorted(named) == ["acquirer_countries", "merchants"]
    assert named["acquirer_countries"].columns == ["acquirer_name", "country_code"]
    assert named["merchants"].columns == ["merchant_id", "capture_delay_days_or_immediate_or_manual", "acquirers"]
    plain = TB.load_star(spark, paths, schemas, *TB.placeholder_layout(schemas))
    assert sorted(plain) == ["table_1", "table_2"]
    assert plain["table_2"].columns == ["column_a", "column_b", "column_c"]
    assert sorted(map(tuple, plain["table_1"].collect())) == [("a", "NL"), ("b, c", None)]
    assert sorted(map(tuple, named["acquirer_countries"].collect())) == [("a", "NL"), ("b, c", None)]


def test_copies_overwrite_and_failures_are_raised(spark, tmp_path):
    few, many = spark.range(2), spark.range(5).selectExpr("id", "id * 2 as twice")
    for second in (few, many):
        done = TB.copy_schema_tables({"x": {"t": few, "u": second}, "y": {"t": many}, "none": {}}, f"{tmp_path}/out", at_once=2)
        assert done == {"x": ["t", "u"], "y": ["t"]}
    assert spark.read.parquet(f"{tmp_path}/out/x/u").count() == 5
    assert spark.read.parquet(f"{tmp_path}/out/y/t").columns == ["id", "twice"]
    assert TB.copy_schema_tables({}, f"{tmp_path}/out") == {}
    with pytest.raises(Exception, match="stop here"):
        TB.copy_schema_tables({"x": {"t": spark.range(1).selectExpr("raise_error('stop here') as bad"), "u": few}}, f"{tmp_path}/out")
