"""Times headline queries: BENCH_SF_DIR (tables), BENCH_CPUS (threads); prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from marginalia import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("r01_claim_evidence", "r02_baseline_critique", "r09_observation_attribution", "r13_meta_discourse", "r17_graph_edges", "a07_export", "a09_rule_stats", "a20_burn_and_wrong", "m01_upsert_papers", "w01_cosine_top_k", "w04_dedupe", "w08_entity_sections", "v15_merged_drafts", "x07_sentences", "e03_alpha")
REPEATS = 3


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    took: dict[str, float] = {}
    for name in QUERIES:
        times = []
        for _ in range(1 + REPEATS):  # the first compiles code
            began = time.perf_counter()
            found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
