"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of parquet tables (default /root/testdata/sf0.1).
BENCH_CPUS: local threads (default: all).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from nearpair.workload.queries import queries  # noqa: E402

HEADLINE = [
    "token_frequency",
    "token_order_idf",
    # one table, one threshold: the exhaustive join and the methods against it
    "cross_self_ed_skew",
    "prefix_self_ed_skew",
    "ed_join_self_skew",
    "gram_count_self_skew",
    "cluster_self_ed_skew",
    "cross_rs_ed",
    "prefix_rs_ed",
    "cross_self_jaccard",
    # documents: the join without frequencies and the methods against it
    "cross_self_jaccard_documents",
    "prefix_self_jaccard",
    "prefix_self_cosine",
    "prefix_self_dice",
    "prefix_rs_jaccard",
    "cluster_self_jaccard",
    "minhash_self_jaccard",
    "evaluate_pairs",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("nearpair-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", "16")
        # comparing two token sets costs far more than reading the pair: keep partitions small
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "*"))
    table = queries()
    spark.read.parquet(f"{folder}/part.parquet").count()  # start the executors
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        table[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "similarity join queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
