"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from riskloom.plans import QUERIES
from riskloom.session import build_session

HEADLINE = (
    "score_mix",
    "velocity_counts",
    "decisions_over_time",
    "busiest_cards",
    "decode_valid",
    "average_precision",
    "average_precision_lineitem",
    "policy_costs",
    "choose_thresholds",
    "budget_table",
    "calibrated_risk",
    "exact_price_quantiles",
    "stratified_split",
    "latest_decisions",
    "hash_identities",
    "request_latency",
    "stream_ingest_stats",
    "stream_decisions",
    "isolation_forest",
    "train_metadata",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("count(*)", "sum(value)").collect()
    timed = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.perf_counter() - started, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rates = {
        "score_rows_per_s": round(events / timed["score_mix"]),
        "decode_rows_per_s": round(events / timed["decode_valid"]),
        "ranking_rows_per_s": round(lines / timed["average_precision_lineitem"]),
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "rates": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
