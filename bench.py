"""Times the headline queries on ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from kgweave.workload import queries as work

HEADLINE = [
    "closure_pairs", "rdfs9", "rdfs_simple", "rdfs_default", "horst_rdfp2", "owl_horst", "owl_rl",
    "owl_el", "bc_type", "bc_property", "type_signatures", "encode_decode", "ntriples_roundtrip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("kgweave-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    start = time.time()
    triples = work.kg(spark, folder).count()
    work.catalog(spark, folder).count()
    times["ingest"] = round(time.time() - start, 3)
    for name in HEADLINE:
        work.forget_results()
        start = time.time()
        work.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline reasoning queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "triples": triples, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
