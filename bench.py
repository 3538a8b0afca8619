"""Time the headline queries; prints one JSON line with each query's median.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all), BENCH_QUERIES (comma-separated),
BENCH_REPEATS (default 3; a query of more than 10 seconds is run twice at most).
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from marketloom import registry  # noqa: E402
from marketloom.session import build_session  # noqa: E402

HEADLINE = [
    "item_cosine", "user_cosine", "item_neighbours_large", "user_neighbours_large", "item_cf", "user_cf", "feature_cf",
    "hybrid", "similar_items", "technical_indicators", "market_metrics", "market_events", "trading_signals", "evaluate",
    "model_comparison", "normalize", "describe", "pivot_table_median", "tf_idf", "correlation_spearman",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    registry.load()
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    shared = tempfile.mkdtemp(prefix="marketloom-bench-")  # one machine: its folder is shared by all tasks
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, spark__checkpoint__dir=shared)
    spark.read.parquet(f"{sf}/region.parquet").count()  # start the executors before timing
    seconds, rows = {}, {}
    for name in names:
        taken: list[float] = []
        while len(taken) < (repeats if not taken or taken[0] <= 10 else min(2, repeats)):
            start = time.time()
            seen = Observation()
            counted = registry.QUERIES[name](spark, sf).observe(seen, F.count(F.lit(1)).alias("n"))
            counted.write.format("noop").mode("overwrite").save()  # computes every column, writes nothing
            rows[name] = seen.get["n"]
            taken.append(time.time() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(name, seconds[name], rows[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows": rows, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
