"""Incremental bronze and keep-best silver with Structured Streaming.

``bronze_stream``: raw CSV files landing in a folder -> bronze Parquet (file
sink, exactly once through the checkpoint). ``best_snapshot_stream``: bronze
Parquet -> streaming aggregation keeping the best snapshot per asset; the state
store holds one row per asset id, and each trigger writes only the assets
whose best snapshot changed. Because the keep-best reduction is associative,
``current_silver`` re-reduces the written updates and equals the batch silver.

The source table has no event time, so there is no watermark: state is
bounded by the number of assets, not by time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.functions.rubric import Rubric
from govlens.operators.silver import best_first, dedup_best, prepare, silver_from_prepared
from govlens.sources.raw import NULL_TOKENS, apply_null_tokens, raw_schema


def bronze_stream(spark: SparkSession, landing: str, bronze_dir: str, checkpoint: str,
                  tokens=NULL_TOKENS, max_files_per_trigger: int | None = None,
                  multi_line: bool = False):
    """Start an available-now stream from raw CSV files to bronze Parquet.

    Every file's header must list the raw columns in source order (``enforceSchema`` off:
    Spark compares it file by file); a file with another header fails the stream."""
    reader = (spark.readStream.schema(raw_schema()).option("header", True).option("enforceSchema", False)
              .option("multiLine", multi_line).option("escape", '"'))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(landing)
    bronze = apply_null_tokens(raw, tokens).withColumns({
        "_ingestion_timestamp": F.current_timestamp(),
        "_source_file": F.regexp_replace(F.input_file_name(), r"\?.*$", ""),
    })
    return (bronze.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(bronze_dir))


def best_snapshot_stream(spark: SparkSession, bronze_dir: str, updates_dir: str,
                         checkpoint: str, bronze_schema=None, synonyms=None):
    """Start an available-now stream keeping the best snapshot per asset id.

    Each micro-batch writes the changed (id, best row) pairs to
    ``updates_dir/batch=<id>``; a re-run after a failure rewrites the same
    batch folder (idempotent overwrite), so the output stays exactly once.
    """
    schema = bronze_schema or spark.read.parquet(bronze_dir).schema
    typed = prepare(spark.readStream.schema(schema).parquet(bronze_dir), synonyms)
    cols = typed.columns
    best = typed.groupBy("column_id").agg(F.min(best_first(cols, "column_id")).alias("__best"))
    flat = best.select(*[F.col("column_id") if c == "column_id" else F.col(f"__best.{c}").alias(c)
                         for c in cols])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates_dir}/batch={batch_id}")

    return (flat.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())


def current_silver(spark: SparkSession, updates_dir: str, rubric: Rubric | None = None) -> DataFrame:
    """Silver from the accumulated keep-best updates."""
    updates = spark.read.parquet(updates_dir).drop("batch")
    return silver_from_prepared(updates, rubric)


BUCKET = "_bucket"


def upsert_best(batch: DataFrame, table_dir: str, buckets: int = 64, key: str = "column_id") -> None:
    """Merge prepared rows into the stored keep-best table at ``table_dir``, copying only the buckets
    that hold a key of the batch.

    The table is partitioned by a hash bucket of the key, one file a bucket. Touched buckets are read,
    reduced together with the batch and written in place of the old ones (dynamic partition
    overwrite: staged, then moved); others are neither read nor written. The reduction is
    idempotent, so a batch that is repeated after a failure leaves the same table. ``buckets`` is
    fixed by the first batch: size it so that one holds a few hundred MB."""
    spark = batch.sparkSession
    number = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    # per task first: a key of very many snapshots is a row of each
    new = dedup_best(batch.drop(BUCKET), key).withColumn(BUCKET, number)
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # bounded by ``buckets``
    try:
        old = spark.read.schema(new.schema).parquet(table_dir).filter(F.col(BUCKET).isin(touched))
        new = old.unionByName(new)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    merged = dedup_best(new.drop(BUCKET), key).withColumn(BUCKET, number)
    (merged.repartition(min(len(touched), buckets) or 1, BUCKET).write.mode("overwrite").partitionBy(BUCKET)
     .option("partitionOverwriteMode", "dynamic").parquet(table_dir))


def upsert_stream(spark: SparkSession, bronze_dir: str, table_dir: str, checkpoint: str, buckets: int = 64,
                  bronze_schema=None, synonyms=None, max_files_per_trigger: int | None = None):
    """Start an available-now stream that merges new bronze files into the stored keep-best table."""
    schema = bronze_schema or spark.read.parquet(bronze_dir).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_best(batch, table_dir, buckets)

    return (prepare(reader.parquet(bronze_dir), synonyms).writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())


def stored_silver(spark: SparkSession, table_dir: str, rubric: Rubric | None = None) -> DataFrame:
    """Silver from the stored keep-best table."""
    return silver_from_prepared(spark.read.parquet(table_dir).drop(BUCKET), rubric)


def fire_once_stream(spark: SparkSession, alerts_dir: str, fired_dir: str, checkpoint: str, schema):
    """Start an available-now stream over alert rows (``rule_id``, ``triggered``, ...; any number of
    writers append to ``alerts_dir``) that fires every rule once.

    Which rules have fired is the stream's keyed state. A batch's rules go to ``fired_dir/batch=<id>``,
    overwritten when the batch is repeated, so a replay fires nothing twice."""
    rows = spark.readStream.schema(schema).parquet(alerts_dir).filter("triggered").drop("triggered")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("fired_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{fired_dir}/batch={batch_id}")

    return (rows.dropDuplicates(["rule_id"]).writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())
