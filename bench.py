"""Time the registered queries and print one JSON line.

Every result is written in full to the ``noop`` sink, so nothing is skipped and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from cohortlab.plans.queries import REGISTRY
from cohortlab.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]


def run() -> dict:
    spark = local_session(CORES, "cohortlab-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{FOLDER}/customer.parquet").groupBy("c_mktsegment").count().collect()
    seconds = {}
    for name, query in REGISTRY.items():
        if ONLY and name not in ONLY:
            continue
        start = time.perf_counter()
        query(spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    return {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }


if __name__ == "__main__":
    print(json.dumps(run()))
