"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from nearspark.catalog import neighbours as N
from nearspark.catalog import reduction, tables  # noqa: F401
from nearspark.catalog.registry import QUERIES
from nearspark.operators import reduction as R
from nearspark.operators.knn import KnnLimits
from nearspark.operators.sampling import random_split
from nearspark.plans.jobs import classify_1nn

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "src_parse_lines", "convert_instances", "profile_dataset", "row_index", "bagging", "rsplit_taken", "attr_ranges",
    "knn_join_k5", "knn_join_tabular", "knn_join_cells", "knn_self_join_lineitem", "classify_knn_k5",
    "classify_knn_lineitem", "confusion_long", "lookup_1nn_lineitem", "enn_global", "enn_lineitem", "fusion_round",
    "reduce_enn_1nn_lineitem",
]


def b1(plan):
    def run(spark, rows):
        train, test = N.split(N.embedding_vectors(spark, SF_DIR))
        return N.join(test, train, 5, plan=plan)

    return run


def b2(spark, rows):
    queries, train = random_split(rows, "id", 1000, seed=42)
    return N.join(queries, train, 9, plan="broadcast_queries")


def b3(plan):
    def run(spark, rows):
        strata = R.stratify(rows, "id", 600, seed=42).withColumnRenamed("id", "pid")
        return R.edit_nearest(strata, by="stratum", plan=plan)

    return run


def b4(spark, rows):
    prototypes, others = random_split(rows, "id", 1000, seed=42)
    return classify_1nn(others, prototypes.withColumnRenamed("id", "pid"))


def b5(spark, rows):
    """The 3 nearest others of every line item in the whole table, both sides spread over cells."""
    return N.join(rows, rows, 3, exclude_self=True, plan="cells", limits=KnnLimits(block_rows=1 << 15))


JOBS = {
    "b1_embeddings_broadcast_train": b1("broadcast_train"),
    "b1_embeddings_broadcast_queries": b1("broadcast_queries"),
    "b2_lineitem_1000_queries": b2,
    "b3_enn_600_strata_broadcast_train": b3("broadcast_train"),
    "b3_enn_600_strata_cells": b3("cells"),
    "b4_score_1000_prototypes": b4,
    "b5_self_join_lineitem_cells": b5,
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("nearspark-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="nearspark-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: (lambda s, rows, q=QUERIES[name]: q(s, SF_DIR)) for name in HEADLINE} | JOBS
    wanted = sys.argv[1:] or list(jobs)
    rows = N.lineitems(spark, SF_DIR)  # input of b2-b5, written before the clock starts; queries build their own
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        jobs[name](spark, rows).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
