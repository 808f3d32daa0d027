"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the
local cores.  Every query runs once, to completion, into a sink that discards rows.
One untimed run of a query on the smallest data set starts the JVM and its compiler.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from ledgerlens import plans  # noqa: E402
from ledgerlens.session import configure  # noqa: E402

HEADLINE = [
    "period_comparison", "report_analytics", "company_profile", "cohort_benchmark", "tone_scores",
    "risk_extraction", "risk_evolution", "section_detection", "filing_chunks", "metric_extraction",
    "vector_search", "filtered_vector_search", "retrieval_run", "assembled_context", "memo_sections",
    "number_grounding", "trailing_event_counts", "latency_stats", "prior_report", "tone_evolution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ledgerlens.spread", cpus)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    plans.QUERIES["period_comparison"](spark, small if os.path.isdir(small) else sf_dir).write.format(
        "noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
