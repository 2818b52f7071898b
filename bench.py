"""Benchmark: headline reports at $BENCH_SF_DIR on local[$BENCH_CPUS].

The stand-in ledger is written once to a scratch folder (timed apart), and the
reports read it from there. Each query runs once to warm the JVM and code
generation, then $BENCH_REPS times into Spark's ``noop`` sink (the whole plan
executes, nothing is collected); the median is reported. The report suite is
timed from its first scan to its last written file. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ledgerlens.plans import catalog  # noqa: E402
from ledgerlens.plans.reports import LedgerReports  # noqa: E402
from ledgerlens.plans.suite import ReportSuite  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.standin import standin_tables  # noqa: E402

HEADLINE = (
    "status_summary_weekly_all",
    "status_summary_monthly_all",
    "asset_counts_weekly_by_slice",
    "matrix_wide_count_weekly_all",
    "pending_detail",
    "pending_by_provider",
    "provider_ranking",
)


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed(fn, reps: int) -> float:
    fn()  # warm-up
    times = []
    for _ in range(reps):
        t = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t)
    return round(statistics.median(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="ledgerlens-bench",
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
    results: dict[str, float] = {}
    scratch = tempfile.TemporaryDirectory(prefix="ledgerlens-bench-", ignore_cleanup_errors=True)
    t = time.perf_counter()
    tables = standin_tables(spark, sf_dir, scratch.name)
    results["ingest_standin_ledger_once"] = round(time.perf_counter() - t, 3)

    def report(name: str) -> None:
        reports = LedgerReports(tables)
        _noop(catalog.build(name, reports))
        reports.release()

    for name in HEADLINE:
        results[name] = _timed(lambda n=name: report(n), reps)
    headline_total = round(sum(v for k, v in results.items() if k in HEADLINE), 3)

    def run_suite() -> None:
        suite = ReportSuite(tables)
        suite.write(tempfile.mkdtemp(dir=scratch.name))
        suite.release()

    results["suite_all_reports_one_snapshot"] = _timed(run_suite, max(1, reps // 2 + 1))

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.count(F.lit(1))).first()[0]
    print(json.dumps({"metric": "headline_reports_total", "value": headline_total, "unit": "sec",
                      "queries": results, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "ledger_rows": rows, "cpus": cpus, "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
