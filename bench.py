"""Headline timings; prints one JSON line.

Queries run in this order in one session.  Shared intermediates (trials, map,
plan, prior, query rows, pairs, metrics) are written once and their time counts
for the first query that needs them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = (
    "site_counts",
    "cut_epochs",
    "rms",
    "trials_to_map",
    "site_channel_pairs",
    "build_features",
    "context_plan",
    "nested_predictions",
    "repeat_metrics",
    "patient_metrics",
    "effect_summary",
    "bootstrap_ci_full",
    "signflip_mc_full",
    "matched_controls",
)


def main() -> None:
    from sparkmap.catalog import load
    from sparkmap.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.range(10).count()
    seconds = {}
    for name in QUERIES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "reconstruction_and_inference_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
