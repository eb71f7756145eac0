"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from trackloom import registry

HEADLINE = [
    "enrich_speed",
    "energy_rate",
    "decompose_acceleration",
    "interpolate_linear",
    "track_summary",
    "quantile_class",
    "rank_position",
    "global_boundaries",
    "nmea_tokenize",
    "group_gsv",
    "filter_invalid",
    "consolidate",
    "align_satellites",
    "apply_cuts_track",
    "merge_tracks_bridge",
    "sample_dem_nearest",
    "smooth_dem",
    "densify_segments",
    "process_nmea",
    "write_track_document",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trackloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    if not os.environ.get("BENCH_SHARED_DIR"):
        os.environ["BENCH_SHARED_DIR"] = tempfile.mkdtemp(prefix="trackloom-bench-")
    builder = builder.config("spark.checkpoint.dir", os.environ["BENCH_SHARED_DIR"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    # one small query first, so that the first timing is not that of the JVM
    registry.QUERIES["row_index"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(found.group(1)) if found else None,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
