"""Times headline queries once each, after a warm-up of the JVM, and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose tables and cores. Results are written to Spark's
no-op sink, so that every row and column is computed and none comes to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RANGE_READS = 20

HEADLINE = [
    "get", "selector_offset", "get_range", "get_range_byte_limit", "segmented_range", "get_range_stream", "mapped_range_get", "mapped_range_scan", "graph_neighbors",
    "asof_seek", "interval_overlap", "consistency_compare", "atomic_add", "atomic_max", "set_clear", "clear_range", "counter_rollup", "inventory_sum",
    "indexed_set", "range_split_points", "read_hot_ranges", "ddsketch_percentile", "sketch_compare", "mvcc_state_at", "conflict_detect", "write_range_union",
    "krm_paint", "overlap_counts", "set_symmetric_difference", "queue", "vector_get_range", "blob_read", "pubsub_inbox", "restore_to_version", "cdc_routing",
    "read_range_buckets", "compressed_column",
]


def main() -> None:
    from keyloom.plans import catalog

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").agg(F.sum("l_quantity")).collect()
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    # the one published figure of a like kind: keys a second from reads of 1000-key ranges, on a copy that is sorted by key
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    store = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(F.monotonically_increasing_id().alias("key"), F.col("l_extendedprice").alias("value"))
    n = store.count()
    store.select((F.row_number().over(Window.orderBy("key")) - 1).cast("bigint").alias("key"), "value").write.parquet(f"{folder}/kv")
    store = spark.read.parquet(f"{folder}/kv")
    rows = 0
    start = time.perf_counter()
    for k in range(RANGE_READS):
        begin = k * n // RANGE_READS
        rows += len(store.where((F.col("key") >= begin) & (F.col("key") < begin + 1000)).toArrow())
    rate = rows / (time.perf_counter() - start)
    start = time.perf_counter()
    store.where(F.col("key") >= 0).write.format("noop").mode("overwrite").save()
    scan = n / (time.perf_counter() - start)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": int(CPUS), "range_keys_per_s": round(scan), "small_range_keys_per_s": round(rate)}))
    spark.stop()


if __name__ == "__main__":
    main()
