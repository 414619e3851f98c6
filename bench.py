"""Benchmark: run every registered query at $BENCH_SF_DIR and print one JSON line.

Each query is executed in full with the ``noop`` sink (all stages run, nothing
is collected), so the time is the engine's, not the driver's.  One warm-up
query runs first so JVM start-up and class loading are not charged to a key.

Every query runs BENCH_REPEAT times.  ``queries`` holds the best (warm) time
per key: steady-state execution, with the plan's generated code already
compiled, which is what a long-running cluster session sees.  ``cold`` holds
the first run of each key (plan compilation included).  ``value`` is the sum
of the warm times; ``cold_total`` the sum of the cold ones.

What a query writes below the shared folder (``spark.checkpoint.dir``, or the
warehouse) is removed after the run.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default all), BENCH_REPEAT (default 3).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimspark.plans.session import (  # noqa: E402
    build_session, recommended_shuffle_partitions, scratch_scope,
)
from claimspark.queries import QUERIES  # noqa: E402


def input_bytes(sf_dir: str) -> int:
    total = 0
    for name in os.listdir(sf_dir):
        p = os.path.join(sf_dir, name)
        if os.path.isfile(p):
            total += os.path.getsize(p)
    return total


def driver_memory() -> str:
    """About 60% of physical memory, at most 16g (local mode: one JVM)."""
    if "BENCH_DRIVER_MEMORY" in os.environ:
        return os.environ["BENCH_DRIVER_MEMORY"]
    try:
        with open("/proc/meminfo") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("MemTotal:"))
        return f"{max(1, min(16, int(kb * 0.6 / 1024 / 1024)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    keys = wanted or list(QUERIES)
    parts = recommended_shuffle_partitions(input_bytes(sf_dir), cpus)
    spark = build_session(
        f"local[{cpus}]", app_name="claimspark-bench", shuffle_partitions=parts,
        extra={"spark.driver.memory": driver_memory()},
    )
    def run(key: str) -> None:
        with scratch_scope(spark):
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("procedure_adoption")

    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for key in keys:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(key)
            runs.append(time.perf_counter() - t0)
        cold[key] = round(runs[0], 3)
        times[key] = round(min(runs), 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "sum_warm_query_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold_total": round(sum(cold.values()), 3),
        "cold": cold,
        "repeat": repeat,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "shuffle_partitions": parts,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
