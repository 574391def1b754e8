"""Time every registered query and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose tables and
cores; BENCH_RUNS (default 3) is the number of runs of which the fastest counts. Batch
results go to Spark's ``noop`` sink, so that all rows and columns are computed and none
are collected. A stream's time includes its sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.plans import QUERIES  # noqa: E402
from millrace.session import session  # noqa: E402


def _scale(root: str) -> float | str:
    name = Path(root).name
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        settings={
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    only = sys.argv[1:] or list(QUERIES)
    run("nation_revenue")  # starts executors and the code cache; not counted
    seconds = {name: round(min(run(name) for _ in range(runs)), 3) for name in only}
    spark.stop()
    report = {
        "metric": "total of the fastest run of every query",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": _scale(root),
        "cpus": int(cpus),
        "runs": runs,
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
