"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the
data and the cores. Each query runs twice; the second time is the one reported, the first
(with code generation and file listing) is kept under ``cold``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.session import build_session  # noqa: E402
from ledgerloom.suite import QUERIES  # noqa: E402

HEADLINE = [
    "kpi_daily_transactions", "kpi_customer_risk", "kpi_top_merchants", "overview_kpis", "top_merchants",
    "txn_amount_bins", "txn_channel", "dashboard_charts", "join_merchant_lookup", "join_tx_fraud_left",
    "join_multi_left_using", "join_left_count_accounts", "fraud_rate_by_channel", "top_merchants_by_amount",
    "daily_volume", "latest_landed", "registry_update", "search_any_cell", "profile_numeric", "scan_csv_raw",
    "process_landing", "curate", "curate_and_load", "readonly_sql",
]


def run(spark, name: str, folder: str) -> float:
    """Seconds to build the query and compute all of its rows."""
    start = time.time()
    QUERIES[name].build(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold = {name: run(spark, name, folder) for name in HEADLINE}
    warm = {name: run(spark, name, folder) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline queries, warm total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
