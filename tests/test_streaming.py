"""Incremental bronze + keep-best stream equals the batch silver."""

import os
import tempfile

from pyspark.sql import functions as F

from govlens.operators.silver import build_silver
from govlens.sources.raw import RAW_COLUMNS, raw_from_lineitem, read_raw_csv
from govlens.streaming.incremental import best_snapshot_stream, bronze_stream, current_silver


def _write_csv(df, path):
    df.select(*RAW_COLUMNS).coalesce(1).write.mode("overwrite").option("header", True) \
        .option("escape", '"').csv(path)


def test_incremental_equals_batch(spark):
    work = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    landing, bronze, updates = (os.path.join(work, d) for d in ("landing", "bronze", "updates"))
    raw = raw_from_lineitem(spark, "/root/testdata/sf0.001")
    first, second = raw.filter(F.col("column_id") < "5"), raw.filter(F.col("column_id") >= "5")
    _write_csv(first, f"{landing}/part1")
    bronze_stream(spark, f"{landing}/*", bronze, f"{work}/ck_bronze").awaitTermination()
    best_snapshot_stream(spark, bronze, updates, f"{work}/ck_best").awaitTermination()
    _write_csv(second, f"{landing}/part2")
    bronze_stream(spark, f"{landing}/*", bronze, f"{work}/ck_bronze").awaitTermination()
    best_snapshot_stream(spark, bronze, updates, f"{work}/ck_best").awaitTermination()

    drop = ["_ingestion_timestamp", "_source_file"]
    inc = current_silver(spark, updates).drop(*drop)
    batch = build_silver(read_raw_csv(spark, f"{landing}/*")).drop(*drop)
    assert inc.count() == batch.count() == 1718
    assert inc.exceptAll(batch).count() == 0 and batch.exceptAll(inc).count() == 0
