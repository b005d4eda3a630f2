"""Time the headline queries and print one JSON line.

Each query is run to completion into a sink that discards the rows, once to warm
up and then ``BENCH_REPEATS`` times; the median counts. Streaming queries are
replays with their own start-up and are run ``BENCH_STREAM_REPEATS`` times.
``BENCH_QUERIES`` names other queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timbrewatch.catalog.queries import QUERIES
from timbrewatch.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
STREAM_REPEATS = int(os.environ.get("BENCH_STREAM_REPEATS", "1"))
HEADLINE = (
    "flagged_windows sliding_window_agg cross_chunk_windows chunk_dedup chunk_gap_check power_spectrum "
    "mel_irregularity f0_contour micro_pauses speech_runs spoof_score feature_assembly call_spoof_rollup "
    "verify_claimed identify_topk risk_score call_status tier_transition txn_hold txn_asof_verdict audit_record "
    "audit_chain audit_verify audit_query content_ref_check anomaly_cells confusion_by_generator roc_eer "
    "latency_report sliding_window_stream txn_hold_stream audit_append"
)
CHOSEN = os.environ.get("BENCH_QUERIES", "").replace(",", " ").split() or HEADLINE.split()


def is_stream(name: str) -> bool:
    return "stream" in name or name == "audit_append"


def run_once(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    timings: dict[str, float] = {}
    for name in list(QUERIES) if CHOSEN == ["all"] else CHOSEN:
        repeats = STREAM_REPEATS if is_stream(name) else REPEATS
        run_once(spark, name)
        timings[name] = round(statistics.median(run_once(spark, name) for _ in range(repeats)), 4)
        print(f"{name:28s} {timings[name]:8.3f}", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "stream_chunks_per_sec": {
            n: round(events / t) for n, t in timings.items() if is_stream(n) and n != "cross_chunk_windows_stream"},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
