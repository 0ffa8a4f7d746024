"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) names the tables, ``BENCH_CPUS`` the cores.
Every query is run once to warm the JVM up and once for the clock; results are counted and
hashed in full, so nothing can be skipped by the optimiser.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from panelwell.registry import REGISTRY, frames
from panelwell.session import local_session, run_scope

HEADLINE = (
    "table_digest",
    "id_ranges",
    "clip_upper_quantile",
    "cohort_build",
    "dedup_responses_12h",
    "coverage_gate",
    "summary_stats",
    "sampler_grid",
    "cohort_by_setting",
    "walk_forward_cyclic",
    "dual_scale",
    "fold_matrix_stats",
    "pooled_metrics",
    "cluster_bootstrap",
)


def consume(df) -> int:
    row = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("h"), F.bit_xor("h")).first()
    return int(row[0])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    seconds: dict[str, float] = {}
    for name in names:
        for timed in (False, True):
            frames.forget_bounds()
            start = time.perf_counter()
            with run_scope(spark):
                rows = consume(REGISTRY[name].run(spark, sf_dir))
            took = time.perf_counter() - start
            if timed:
                seconds[name] = round(took, 3)
                print(f"{name}: {rows} rows, {took:.2f} s", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
