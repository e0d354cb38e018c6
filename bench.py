"""Times the headline queries: one JSON line with seconds for each and in all."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from parcelmint.plans import catalog

HEADLINE = ["C20", "A01", "J1", "A02", "J3", "C09", "X16", "A05", "A06", "A04", "W03", "C17", "C21", "J14", "W01", "X21"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
