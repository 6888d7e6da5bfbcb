"""Benchmark: wall time of all registered queries of the library.

Runs each query on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS], writes the result to the `noop` sink (the whole plan runs, no
rows go to the driver), one warm-up run then the median of $BENCH_REPEAT runs.
`queries` holds whole times, `build_seconds` the part that goes into building the frame
(plan construction and the jobs a query runs before it returns).  Prints one JSON line.
The training-data operators are measured by the check tool instead (README).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in sys.argv[1:]]
    from calibra.session import build_session
    from calibra.registry import QUERIES
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="calibra-bench")
    names = only or list(QUERIES)
    times, build = {}, {}
    for name in names:
        fn = QUERIES[name]
        runs, plans = [], []
        for i in range(repeat + 1):                       # the first run warms up
            t = time.perf_counter()
            df = fn(spark, sf_dir)
            built = time.perf_counter() - t
            df.write.format("noop").mode("overwrite").save()
            if i or not repeat:
                runs.append(time.perf_counter() - t)
                plans.append(built)
        times[name], build[name] = round(statistics.median(runs), 3), round(statistics.median(plans), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "build_seconds": build, "sf": sf, "cpus": cpus,
                      "shuffle_partitions": cpus * 2, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
