"""Benchmark: lineitem-derived catalog -> silver -> gold tables -> trusted questions.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
     BENCH_OUT (folder for silver and gold; default: the session's checkpoint folder,
     else a new /tmp/run-* folder).
Gold tables and questions are timed one at a time, so each figure is that query's own.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("govlens-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(cpus * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.driver.memory", "16g")
             .config("spark.scheduler.mode", "FAIR")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from govlens.operators.silver import build_silver
    from govlens.plans import semantic as SEM
    from govlens.plans.hints import ensure_checkpoint_dir
    from govlens.plans.pipeline import STORED_TABLES, gold_tables, write_bucketed, write_gold
    from govlens.sources import reference as R
    from govlens.sources.raw import bronze_from_lineitem

    base = os.environ.get("BENCH_OUT") or ensure_checkpoint_dir(
        spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    out = f"{base.rstrip('/')}/bench-{int(time.time())}"
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        r = fn()
        times[name] = round(time.time() - t, 3)
        return r

    # warm-up: JVM, parquet reader and codegen on the smallest input
    warm = build_silver(bronze_from_lineitem(spark, "/root/testdata/sf0.001"), stripped=True)
    warm.write.format("noop").mode("overwrite").save()

    t0 = time.time()
    buckets = cpus * 2
    table = f"bench_silver_{int(time.time())}"
    timed("raw_to_silver", lambda: write_bucketed(
        build_silver(bronze_from_lineitem(spark, sf_dir, partitions=cpus * 2), stripped=True), table, buckets=buckets,
        path=f"{out}/silver"))
    silver = spark.table(table)
    gold = gold_tables(silver, R.region_assignment(spark), R.user_profile(spark))
    timed("silver_to_gold", lambda: write_gold(
        gold, out, STORED_TABLES, parallelism=1,
        on_done=lambda n, s: times.__setitem__(n, round(s, 3))))
    written = gold_tables(silver, R.region_assignment(spark), R.user_profile(spark))
    for name in STORED_TABLES:
        written[name] = spark.read.parquet(f"{out}/{name}")
    q0 = time.time()
    for q, fn in SEM.QUESTIONS.items():
        if q == "catalog_search":
            continue
        timed(f"q_{q}", lambda fn=fn: fn(written).write.format("noop").mode("overwrite").save())
    for m in SEM.MEASURES:
        timed(f"measure_{m}", lambda m=m: SEM.measure(written, m).collect())
    times["questions"] = round(time.time() - q0, 3)
    total = round(time.time() - t0, 3)
    print(json.dumps({"metric": "pipeline_wall_time", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": cpus, "spark": spark.version, "rows_silver": silver.count()}))


if __name__ == "__main__":
    main()
