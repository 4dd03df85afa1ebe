"""Times the headline queries, each once in one session, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from varibreak.catalog import QUERIES
from varibreak.session import build_session

HEADLINE = [
    "wn03_peaks", "ag04_deletion_term", "jn05_hanging_left", "st11_deletion_scan", "ag21_mean_depth", "ag09_consensus", 
    "aln01_genome_matches", "jn03_count_overlaps", "jn11_first_overlap", "wn09_near_duplicates", "cl01_anchor_clusters", "ag01_library_stats",
    "wn10_strict_dedup", "ag16_fold_change_control", "cl02_contrast_clusters", "wn06_running_median", "jn14_adjacent_breakends", "plp01_pileup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
