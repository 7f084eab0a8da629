"""Benchmark: every registered query over the whole tables at one scale factor.

Each query is materialised with the ``noop`` sink (full execution, no collect).
One pass over all queries warms the JVM up; then ``BENCH_REPEAT`` passes are
timed and the per-query number is the median. Prints one JSON line on stdout.

Streaming queries (availableNow runs over the event files), answers from sketches or bitmaps and the sink
that writes every mart are timed once each and reported under "streaming", "sketches" and "sinks"; they are not part of the headline sum.
Nothing is prepared beforehand: every query derives its tables from the raw files.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3), BENCH_QUERIES (comma list, default all).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from aislewise.plans.registry import QUERIES, SINKS, SKETCHES, STREAMING
    from aislewise.session import local_session

    spark = local_session(cores=str(cpus), shuffle_partitions=cpus, app="aislewise-bench")
    spark.sparkContext.setLogLevel("ERROR")

    names = wanted or [q for q in QUERIES if q not in STREAMING and q not in SINKS and q not in SKETCHES]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:  # warm-up pass
        run(name)
    samples: dict[str, list[float]] = {name: [] for name in names}
    for _ in range(repeat):
        for name in names:
            samples[name].append(run(name))
    timings = {name: round(statistics.median(v), 4) for name, v in samples.items()}
    streaming = {} if wanted else {name: round(run(name), 4) for name in STREAMING}
    sketches = {} if wanted else {name: round(run(name), 4) for name in SKETCHES}
    sinks = {} if wanted else {name: round(run(name), 4) for name in SINKS}

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "streaming": streaming,
                "sketches": sketches,
                "sinks": sinks,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "repeat": repeat,
                "driver_memory": spark.conf.get("spark.driver.memory", "default"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
