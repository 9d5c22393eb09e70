"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

RUNS = 2


def main() -> None:
    import scrivana.plans.views  # noqa: F401
    from scrivana.plans.catalog import QUERIES
    from scrivana.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name, f in QUERIES.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "median seconds, all retrieval queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
