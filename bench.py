"""Times the headline queries once each; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessella.plans.registry import QUERIES

NAMES = ("bm25_top3", "dense_top3", "token_f1_turns", "chunk_md5_dedup", "entropy_trend", "smooth_trend", "benefit_grouping_sets", "oracle_gain", "tree_backprop", "sibling_pairs", "percentiles_over_threshold", "hash_split")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.cteRecursionRowLimit", "100000000").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
