"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores. Every query runs once
to warm up and once for the record; results go to a sink that reads all of them and keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sightline.plans.catalog import QUERIES
from sightline.session import session

HEADLINE = [
    "site_severity_summary", "injected_issues", "injected_site_summary", "page_site_totals", "enriched_issues",
    "issue_details", "nested_report", "page_elements_by_tag", "page_links", "resolved_links", "contrast_ratios",
    "applied_fixes", "fixed_pages", "blocked_urls", "scan_runs", "rate_grants", "adaptive_rates", "crawl_site",
    "scan_history", "stream_scan",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "sightline-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm, cold = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        for times in (cold, warm):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cold_queries": cold,
        "pages_per_sec": round(pages / warm["injected_issues"], 1) if "injected_issues" in warm else None,
    }))


if __name__ == "__main__":
    main()
