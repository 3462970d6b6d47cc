"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Mirrors how the reference is used: the raw tables are imported and cleaned once
into the bronze / silver Parquet layers (timed as ``clean_to_silver``), then every
analysis runs against them.  Each query is run once to warm up and then timed
(best of $BENCH_REPEAT) executing the whole plan into Spark's ``noop`` sink, so
the time is the query's, not the Python conversion of its result rows.  Prints
ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [x for x in os.environ.get("BENCH_QUERIES", "").split(",") if x]

    from pricelens.plans import registry
    from pricelens.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus), driver_memory="16g")
    t0 = time.time()
    registry.engine_for(spark, sf_dir)
    clean = time.time() - t0

    timings: dict[str, float] = {}
    for name, build in registry.spark_queries().items():
        if only and name not in only:
            continue
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        best = None
        for _ in range(repeat):
            t = time.time()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t
            best = dt if best is None else min(best, dt)
        timings[name] = round(best, 3)
    total = sum(timings.values())
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_warm_query_seconds",
        "value": round(total, 3),
        "unit": "sec",
        "queries": timings,
        "clean_to_silver_sec": round(clean, 3),
        "median_query_sec": round(sorted(timings.values())[len(timings) // 2], 3) if timings else None,
        "n_queries": len(timings),
        "sub_second_queries": sum(1 for v in timings.values() if v < 1.0),
        "sf": sf,
        "spark": spark.version,
        "master": f"local[{cpus}]",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
