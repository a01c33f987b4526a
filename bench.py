"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every query is written to the ``noop`` sink, so all columns of all rows are computed. The session
is warmed up by one untimed run of the first query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from evalspark import catalog
from evalspark.session import clear_scratch, local_session

HEADLINE = [
    "total_fees",
    "wildcard_rule_join",
    "steering_recommendation",
    "fee_delta_mcc_change",
    "monthly_merchant_stats",
    "dedupe_latest",
    "check_event_balance",
    "run_summary",
    "matrix_transitions",
    "model_leaderboard",
    "stratified_split",
    "compare_results",
    "column_jaccard_exact",
    "mine_joins",
    "mine_field_usage",
    "pair_tool_calls",
    "link_tables_topk",
    "guess_features",
    "stream_dedupe",
]


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    registry = catalog.load()
    spark = local_session(cores, shuffle_partitions=max(int(cores), 1) if cores.isdigit() else 8)
    registry.run(names[0], spark, folder).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        start = time.perf_counter()
        registry.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
