"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data (default sf0.1) and BENCH_CPUS the cores. Three queries run untimed on
the smallest data, to load classes; then every query runs once timed, into a no-op sink. Times
include deriving the layered tables from the driver tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "compact_state",
    "tree_closure",
    "effective_visibility",
    "bbox_rollup",
    "apply_state",
    "apply_overlay",
    "apply_toggles",
    "scan_favorites",
    "view_selects",
    "enumerate_views",
    "resolve_views",
    "distinct_pictures",
    "compose_pixels",
    "compose_groups",
    "blend_soft_light",
    "blend_hue",
    "chop",
    "chop_rasters",
    "map_cells",
    "rebuild_images",
    "image_fingerprint",
    "plan_bundles",
    "debounce_changes",
    "decode_texts",
]

WARM_UP = ["compact_state", "compose_pixels", "map_cells"]


def main() -> None:
    from lamina.catalog import QUERIES
    from lamina.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small):
        for name in WARM_UP:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
