"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "j10_top3_matches",       # flagship: grid join, features, gates, score, top 3
    "j2_radius_pairs",
    "j5_hard_gates",
    "r2_snap_to_nodes",
    "r3_shortest_paths",
    "j15_tier2_gate",
    "e6_pruning_report",
    "a2_greedy_assignment",
    "a8_relocations",
    "p3_best_pool_triples",
    "i2_realised_trips",
    "d2_policy_metrics",
    "b8_promo_application",
    "b9_driver_ratings",
    "b10_wallet_ledger",
    "e1_query_metrics",
    "m3_logistic_fit",
    "t1_tick_windows",
    "t6_incident_alerts",
)


def main() -> None:
    from ridelattice.plans.catalog import QUERIES
    from ridelattice.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, max(8, cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    times: dict[str, float] = {}
    for name in names:
        t = time.time()
        # every column is produced, nothing is collected
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({
        "metric": "total headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
