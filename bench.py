"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of three runs. Prints one JSON line."""

import json
import os
import statistics
import sys
import time

os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"

from loomstone.plans import catalogue  # noqa: E402
from loomstone.session import build_session  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    queries = {}
    for name in sys.argv[1:] or sorted(catalogue.QUERIES):
        times = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        queries[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "catalogue_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": sf, "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
