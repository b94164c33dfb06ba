"""Prints one JSON line with the seconds of headline queries, each the better of two runs."""

import json
import os
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["deepwalk_steps", "deepwalk_broadcast", "deepwalk_multi_rep", "edges_symmetric", "degree", "k_hop_frontier", "triangle_count", "visit_counts", "insert_batch_live", "delete_batch_live", "node2vec_steps", "prefix_scan", "rank_select", "tokenize_word_counts", "rmat_edges"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from driftwalk.queries import QUERIES

    took, walks = {}, 0
    for name in NAMES:
        best = None
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
        if name == "deepwalk_broadcast":
            walks = QUERIES[name](spark, SF).select("walk_id").distinct().count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "walks_per_s": round(walks / took["deepwalk_broadcast"])}))


if __name__ == "__main__":
    main()
