"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlight.plans.catalog import QUERIES  # noqa: E402
from ledgerlight.session import build_session  # noqa: E402

HEADLINE = (
    "cache_activity", "rollup_user", "rollup_team", "rollup_org", "rollup_tag", "rollup_end_user", "rollup_agent",
    "daily_activity_breakdown", "usage_enriched", "focus_normalize", "policy_match", "session_budget", "injection_rules",
    "topic_category", "vector_topk", "stream_daily_metrics",
)


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session("bench", master=f"local[{cpus}]", partitions=cpus, **{"spark.driver.memory": "12g"})
    # The first run of a query pays for class loading and code generation; both runs are reported.
    cold = {name: round(timed(spark, name, sf_dir), 3) for name in names}
    warm = {name: round(timed(spark, name, sf_dir), 3) for name in names}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
                      "first_run": cold, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
