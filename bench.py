"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reclattice.plans.queries import QUERIES
from reclattice.session import local_session

HEADLINE = [
    "load_movielens_20m",
    "min_activity",
    "split_train",
    "split_test",
    "user_item_matrix",
    "gram",
    "topk_scores",
    "metric_panel_part",
    "ease_recs_brand_size",
    "slim_recs_brand_size",
    "als_recs_part",
    "grid_history_ease",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "reclattice-bench")
    names = sys.argv[1:] or HEADLINE
    # The first query pays for JVM and Python worker start; it is run once unmeasured.
    QUERIES["gram_raw_ratings"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        spark.catalog.clearCache()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
