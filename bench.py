"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "x5_extract_strength", "x6_extract_dosage_form", "g1_dedupe_keep_first", "g3_merge_cached_live",
    "g4_propagate_by_molecule", "j2_search_many", "j5_star_join", "j7_attach_by_url", "a1_count_by", "a4_default_category",
    "l1_sort_default", "l3_top_n", "k2_upsert_products", "a7_latest_health", "t6_classify_outcome", "x39_display_row",
    "e2_saved_search", "e1_search", "d13_enrich_rows", "t5_stream_upsert", "j6_best_match_join", "p15_fuzzy_search_many",
]


def main() -> None:
    from rxatlas.plans import catalog
    from rxatlas.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm-up
    seconds, total = {}, time.time()
    for name in HEADLINE:
        started = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline queries, wall clock", "value": round(time.time() - total, 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
