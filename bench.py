"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from siftwright import suite

HEADLINE = [
    "flagship", "eq_bytes", "in_int_ranges", "in_int_many", "bitand", "and_or_prec", "xor3", "contains", "regex", "wildcard_ci", "wildcard_strict", "any_eq", "any_and_zip", "map_each_len",
    "grid_each", "props_map", "ip_cidr", "ip_set", "concat3", "nested_fn", "list_semi_and", "list_under_or", "value_scalars", "annotate", "json_records",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = suite.queries(), {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 4)
    print(json.dumps({"metric": "total_best_of_3", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
