"""Run registered queries beside their check SQL and compare names, types, rows and values.

Usage: python tools/check.py [-f family,family] [-s sf_dir] [query ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from evalspark import catalog  # noqa: E402
from evalspark.catalog.inputs import RAW_TABLES  # noqa: E402
from evalspark.session import local_session  # noqa: E402


def kind(series: pd.Series) -> str:
    t = series.dtype
    if pd.api.types.is_bool_dtype(t):
        return "bool"
    if pd.api.types.is_integer_dtype(t):
        return "int"
    if pd.api.types.is_float_dtype(t):
        return "float"
    if pd.api.types.is_datetime64_any_dtype(t):
        return "time"
    return "other"


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT:
        return "NULL"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.9g}" if float(v) != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    parts = [[cell(v) for v in frame[c].astype(object)] for c in cols]
    return sorted(zip(*parts)) if cols else []


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"ROWS {len(a)} != {len(b)}\n   spark {a[:3]}\n   sql   {b[:3]}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        only = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"VALUES {len(bad)} differ\n   spark {only[0]}\n   sql   {only[1]}"
    note = ""
    for c in got.columns:
        if len(a) and kind(got[c]) != kind(want[c]) and not (got[c].isna().any() or want[c].isna().any()):
            note += f" type {c}: {kind(got[c])}/{kind(want[c])}"
    return "ok" + (f" ({note.strip()})" if note else "") + (" EMPTY" if not a else "")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-f", "--families")
    ap.add_argument("-s", "--dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    registry = catalog.load(args.families.split(",") if args.families else None)
    names = args.names or list(registry.entries)
    spark = local_session()
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in RAW_TABLES:
        con.execute(f"create view {table} as select * from '{args.dir}/{table}.parquet'")
    failed = []
    for name in names:
        try:
            start = time.time()
            got = registry.run(name, spark, args.dir).toPandas()
            spark_s = time.time() - start
            sql = registry.oracle(name)
            if sql is None:
                verdict, sql_s = f"rows-only {len(got)}", 0.0
            else:
                start = time.time()
                want = con.execute(sql).df()
                sql_s = time.time() - start
                verdict = compare(got, want)
        except Exception as error:  # report every query, then go on
            spark_s = sql_s = 0.0
            text = str(error).split("JVM stacktrace")[0]
            verdict = f"FAILED {type(error).__name__}: {text[:700]}"
            if not text:
                traceback.print_exc()
        if not verdict.startswith(("ok", "rows-only")):
            failed.append(name)
        size = len(got) if verdict.startswith(("ok", "rows")) else "-"
        print(f"{name:34s} {spark_s:6.1f}s {sql_s:6.1f}s rows={size} {verdict}", flush=True)
    print(f"{len(names)} run, {len(failed)} failed: {' '.join(failed)}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
