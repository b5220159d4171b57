"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINES = (
    "p01_point_in_polygon", "p02_zone_corners", "c02_parked_cells", "c05_one_box_per_ball", "t06_descent_runs", "t11_makes", "t13_active_stretches",
    "a01_ballistic_fit", "g05_through_ring", "g13_event_index", "m02_nearest_first", "m04_nearest_mark", "e04_threshold_f1", "i03_classify",
    "i07_overlap_groups", "b03_releases", "p16_landing_centre", "s05_notes_to_key", "st02_window_counts", "t01_build_tracks")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    from pyspark.sql import SparkSession

    from flightline.plans import catalog
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("flightline-bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    catalog.QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM and the page cache
    times = {}
    for name in names:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
