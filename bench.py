"""Times the headline queries at ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]`` and prints one JSON line.

Every query runs whole into a sink that keeps nothing, ``BENCH_RUNS`` times (2 unless set); the best time counts, so
that loading and compiling classes for the first time is left out. Names given as arguments replace the headline list; with
``BENCH_ORACLE=1`` the same queries are also timed in DuckDB.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalog

HEADLINE = [
    "reconcile_rows", "reconcile_rows_fnmatch", "reconcile_status_counts", "reconcile_summary", "classify_repositories",
    "sync_progress", "dedup_first", "tags_from_pages", "plan_rules", "guard_paths", "match_files", "retention_ledger",
    "retention_survivors", "empty_dirs", "run_totals", "host_totals", "complete_reports", "savings_metric",
    "monthly_summary", "consolidate_year", "distinct_members", "scramble_name", "scramble_email", "mask_by_spec",
    "apply_updates", "refresh_tables", "grant_statements", "property_parity", "classify_failure_run", "failure_details",
    "parse_tagged_lines", "human_bytes",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_times(folder: str, names: list[str]) -> dict[str, float]:
    from tests.compare import connect

    con, times = connect(folder), {}
    con.execute(f"SET threads = {os.environ.get('BENCH_CPUS', os.cpu_count())}")
    for name in names:
        if name in catalog.ORACLES:
            start = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE answer AS {catalog.ORACLES[name]}")
            times[name] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count())))
    runs, times, failed = int(os.environ.get("BENCH_RUNS", "2")), {}, {}
    for name in names:
        taken = []
        try:
            for _ in range(runs):
                start = time.perf_counter()
                catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
        except Exception as error:  # one broken query must not hide the others' times; the exit code tells of it
            failed[name] = f"{type(error).__name__}: {error}".splitlines()[0][:200]
        else:
            times[name] = round(min(taken), 3)
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "runs": runs,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_ORACLE"):
        line["duckdb"] = oracle_times(folder, names)
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
