"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from twinframe.session import build_session
from workloads.queries import QUERIES

HEADLINE = [
    "record_count",
    "duplicate_check",
    "null_check",
    "empty_string",
    "pk_match_composite",
    "data_compare_pk",
    "data_compare_duplicate_keys",
    "data_compare_text",
    "data_compare_positional",
    "distinct_count",
    "date_range",
    "row_checksum_duplicate_keys",
    "symmetric_difference",
    "smart_subset_source",
    "quick_sample",
    "dedup_first",
    "csv_roundtrip",
    "validate_standard",
    "validate_regression",
    "validate_regression_lineitem",
]
REPEATS = 2


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "record_count", sf_dir)  # start the JVM's compilers and Spark's reader once
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(min(run(spark, name, sf_dir) for _ in range(REPEATS)), 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    report = {
        "metric": "best_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else None,
        "cpus": int(cpus),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
