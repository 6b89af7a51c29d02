"""Seconds of each stream query at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of runs."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from streamloom.plans.queries import QUERIES

HEADLINE = (
    "filter_map flat_map_words route_if union_streams predicates reduce_by_key_running reduce_by_key_final apply_stateful_max apply_stateful_custom time_window_tumbling "
    "time_window_sliding time_window_hopping count_window_tumbling count_window_sliding count_window_hopping session_window_user session_window_global window_join_purchase_error "
    "reduce_by_key_window apply_stateful_window window_collect state_transition rule_stateful_alarm rule_stateless_alarm cep_strict_pair cep_ndr_pair cep_relaxed_pair cep_times_loop "
    "parse_text punctuated_late_drop"
).split()

def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        function = QUERIES[name]
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            t = time.perf_counter()
            function(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
