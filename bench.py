"""Time the headline queries and print one JSON line.

Every query is planned and run to the end, with its whole result computed and
thrown away. BENCH_SF_DIR names the data, BENCH_CPUS the number of cores.
`python bench.py --all` times every registered query; names time only those.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from twinframe.catalogue import QUERIES
from twinframe.session import PARTITIONS_SETTING, drop_stored

HEADLINE = (
    "pair_features", "scored_pair_features", "turn_edits", "edit_codes", "translations",
    "score_zscores", "first_pairs", "balanced_sample", "stratified_split", "curated_splits",
    "located_events", "gene_records", "prediction_report", "highest_impact",
    "distinct_texts", "encoded_pairs", "pooled_vectors", "pair_vectors",
    "supplier_metrics", "price_auroc", "price_correlations", "price_percentiles", "evaluation",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of every expression are only of use in interactive debugging.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        # The tables are files of one row group, which one task reads.
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config(PARTITIONS_SETTING, cpus)
        .getOrCreate()
    )


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    spent = time.perf_counter() - start
    drop_stored(spark)
    return spent


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    asked = [a for a in sys.argv[1:] if a != "--all"]
    names = asked or (list(QUERIES) if "--all" in sys.argv else list(HEADLINE))
    # Start the workers and load the classes before anything is timed.
    run(spark, "pair_features", folder)
    seconds = {name: round(run(spark, name, folder), 3) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
