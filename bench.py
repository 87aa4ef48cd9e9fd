"""Times the headline queries and prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on
``local[$BENCH_CPUS]``. Every query is run in full once, in this order, after
one small query that starts the engine. ``csv_load`` and ``csv_end_to_end``
read a CSV of the dirty orders that is written beforehand; the latter goes from
the file to ranked decisions.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallylens import build_session, read_table, run, write_table  # noqa: E402
from tallylens.catalog import QUERIES  # noqa: E402
from tallylens.fixtures import dirty_orders  # noqa: E402
from tallylens.session import scratch_path  # noqa: E402

HEADLINES = [
    "sampled_scan", "column_profile", "quality_report", "clean_orders", "analytic_columns", "summary_stats",
    "null_findings", "distribution_lineitem", "categorical", "monthly_trend", "correlation", "zscore_anomaly",
    "full_analysis", "claim_check", "insight_score", "ranked_decisions", "chart_bar", "chart_hist", "chart_line",
    "chart_scatter", "chart_corr_matrix", "stream_batches",
    "csv_load", "csv_end_to_end",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    csv = scratch_path(spark, "orders.csv")
    write_table(dirty_orders(spark, sf_dir), csv)
    jobs = dict(QUERIES)
    jobs["csv_load"] = lambda session, _: read_table(session, csv)
    jobs["csv_end_to_end"] = lambda session, _: run(session, csv)[1].decisions
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        # the noop sink runs the whole plan without moving its rows to the driver
        jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:24s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
