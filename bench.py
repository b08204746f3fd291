"""Times the headline queries and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from logweir.plans.catalog import core_queries

NAMES = ["error_rate_overall", "error_rate_buckets", "error_anomalies", "latency_percentiles", "endpoint_table", "format_probe", "quarantine_split", "record_groups", "keywords_top", "error_templates"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    core_queries()["error_rate_overall"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        core_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("/sf", 1)[-1]}))


if __name__ == "__main__":
    main()
