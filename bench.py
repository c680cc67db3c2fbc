"""Times the headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS set the data and the threads."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from glintdex import catalogue  # noqa: E402
from glintdex.operators import index as I  # noqa: E402
from glintdex.sources.scratch import scratch_folder  # noqa: E402
from glintdex.sources.storage import Store  # noqa: E402

SEARCHES = [
    "search_keyword_single",
    "search_keyword_multi",
    "search_phrase_3",
    "search_prefix_single",
    "search_fuzzy_single",
    "search_regex_class",
    "search_topk_ranked",
    "batch_keyword_search",
    "stats_top_terms",
    "stats_extensions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries: dict[str, float] = {}
    spark.read.parquet(f"{sf}/documents.parquet").count()

    def timed(name: str, f) -> None:
        t = time.time()
        f()
        queries[name] = round(time.time() - t, 3)

    catalogue.index(spark, sf)
    timed("index_build", lambda: Store(spark, scratch_folder(spark)).save(I.build(catalogue.corpus(spark, sf), now=0)))
    for name in SEARCHES:
        run = lambda name=name: catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        run()
        times = []
        for _ in range(3):
            t = time.time()
            run()
            times.append(time.time() - t)
        queries[name] = round(sorted(times)[1], 3)
    print(json.dumps({"metric": "index build and warm search, total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
