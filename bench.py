"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_KEYS (comma-separated keys, or "all"), BENCH_RUNS (default 3). Every query
is built and run in full into a sink that discards its rows, and counts with the
median of its runs; the first run of each meets cold code. After BENCH_SECONDS
(default 900) the queries that are left run once. The first query runs once
beforehand so that the start of the session is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from auditframe.plans import all_queries

HEADLINE = [
    "uc_cost_per_space", "uc_cost_per_conversation", "uc_daily_usage", "uc_kpis",
    "eq_setdiff_counts", "eq_numeric_multiset", "eq_run_rollup",
    "dp_column_profile", "dp_value_lists", "dq_null_metrics", "dq_recommendations", "dq_fk_orphans",
    "tx_families", "tx_coverage_gaps", "tx_dedup_winner", "tx_token_jaccard", "tx_ngram_jaccard", "tx_ngram_jaccard_sql",
    "tx_cosine_match", "tx_leak_decision", "tx_leak_counts",
    "ev_run_scores", "ev_attempts", "ev_sign_test", "cs_history_score", "cs_stable_rank",
    "ct_graph", "ct_scorecard", "ct_maturity", "ct_config_drift",
    "mq_decile_concentration", "mq_days_to_next", "mq_monthly_snapshot", "mq_multi_fact", "st_hourly_usage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("auditframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    queries = all_queries()
    wanted = os.environ.get("BENCH_KEYS", "")
    keys = list(queries) if wanted == "all" else [k for k in wanted.split(",") if k] or HEADLINE

    def run(key: str) -> float:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(keys[0])
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    until = time.perf_counter() + float(os.environ.get("BENCH_SECONDS", "900"))
    times = {key: round(median(run(key) for _ in range(runs if time.perf_counter() < until else 1)), 3) for key in keys}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
