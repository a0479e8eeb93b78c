"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from placewise import plans
from placewise.session import build

HEADLINE = [
    "D1_provider_status", "C3_provider_cards", "M1_near", "M2_nearby", "D2_cities", "D4_availability_tally", "M12_availability_report",
    "C5_alert_match", "M6_pending_alerts", "M7_alert_run", "C10_alternatives", "C11_accepting_nearby", "C15_practices_around",
    "A1_register_read", "L1_upsert_providers", "I1_page_text", "I8_page_verdict", "I10_page_flags", "M10_crawl_evidence",
    "M9_crawl_targets", "I13_site_match", "J1_report_limit", "M5_find_place", "M8_digest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    times = {}
    for name in names:
        for _ in range(2):  # the first run compiles the code, the second one counts
            start = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
