"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 1 timed run after a warm-up run of the first query).
Each query is forced with the ``noop`` sink, so the whole result is
computed without moving it to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphsift.plans.catalog import QUERIES  # noqa: E402
from graphsift.session import get_session  # noqa: E402

HEADLINE = ["node_patterns", "edge_patterns", "property_types_nodes", "cardinality", "node_types",
            "edge_types_by_rel", "ddl_strict", "node_quads_reified", "edge_quads_reified",
            "nquads_lines", "eval_nodes", "node_lsh"]


def run(spark, name: str, sf_dir: str) -> float:
    t = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session()
    run(spark, names[0], sf_dir)  # warm-up (JIT, file listing)
    times = {}
    for n in names:
        times[n] = round(statistics.median(run(spark, n, sf_dir) for _ in range(repeat)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
