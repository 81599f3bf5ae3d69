"""Times the headline queries and prints one JSON line.

All queries run once on the same data before the timed passes; the times of that first pass,
which include class loading and code generation, are given as ``first_pass``. A query's time is the
median of three warm passes, which are given as ``warm_passes``, so that a drift of the machine or the
session during the run is seen.

BENCH_SF_DIR  folder of parquet tables   (default /root/testdata/sf0.1)
BENCH_CPUS    local threads              (default 8)
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from fibrelens.plans.registry import all_queries
from fibrelens.session import build_session

WARM = 3
HEADLINE = [
    "partner_scorecard",
    "city_active_base",
    "daily_leads_installs",
    "mobile_summary",
    "partner_overview",
    "earnings_breakdown",
    "device_location_counts",
    "fixed_payout_bulk",
    "ticket_counts",
    "ticket_sla",
    "live_sla_override",
    "ticket_series",
    "customer_360",
    "signal_summary",
    "churn_estimate",
    "wallet_transactions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        """Seconds to build the plan and to compute every row and column."""
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in HEADLINE}
    warm = [{name: run(name) for name in HEADLINE} for _ in range(WARM)]
    seconds = {name: median(one[name] for one in warm) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries, median of three passes in a warm JVM",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_pass": cold,
                "warm_passes": [round(sum(one.values()), 3) for one in warm],
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
