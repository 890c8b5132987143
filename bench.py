"""Headline timings. Prints one JSON line: seconds per query (median of three) at BENCH_SF_DIR."""

from __future__ import annotations

import json
import os
import statistics
import time

from tonescope.catalog.all import ENTRIES
from tonescope.session import get_session

HEADLINE = ["question_biggest_driver", "question_single_rate", "question_full_report",
            "question_orgs_against_industry", "question_priorities", "question_why_worse",
            "summary_by_topic_per_org", "test_org_against_rest", "test_requested_pairs",
            "rank_all_cells", "params_answerability", "profile_imputed_shares",
            "drift_topic_shares", "runs_scored", "runs_stopping_audit", "runs_leaderboard",
            "calls_path_match", "alpha_ordinal", "alpha_bootstrap", "judge_vs_raters"]
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    ENTRIES["slice_size"].run(spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder), "cores": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
