"""Helpers shared by the operators: intermediate tables in the shared folder,
column selection that ignores extra columns, input sizes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that separate words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
MARKS = 1 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKAGE_ZIP = "govlens-package.zip"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session; a new folder under /tmp only where the session has none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="govlens-ckpt-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from
    files that outlive any executor, and what made them runs once. The shuffle files of the
    write go as soon as it is done."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of :func:`written` tables that no step to come reads, so that the shared folder
    holds what is still needed, not every step of the way. Files outside of it are left alone."""
    for df in tables:
        spark = df.sparkSession
        shared = shared_folder(spark).rpartition(":")[2]
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"{shared}/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (null: empty); others are ignored."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def marked(df: DataFrame, key: str, needed: DataFrame, size: int = MARKS) -> DataFrame:
    """``df`` with boolean column ``marked``: true wherever the long ``key`` is in ``needed``
    (column of the same name), and for few other keys while those are few.

    The broadcast set holds remainders of the needed keys' hashes, so it has at most ``size``
    rows whatever the size of ``needed``; it spares rows a shuffle and decides nothing."""
    def mark():
        return F.pmod(F.xxhash64(key), F.lit(size)).cast("int").alias("_mark")

    marks = needed.select(mark()).distinct().withColumn("marked", F.lit(True))
    return (df.withColumn("_mark", mark()).join(F.broadcast(marks), "_mark", "left").drop("_mark")
            .withColumn("marked", F.coalesce("marked", F.lit(False))))


def likely(df: DataFrame, key: str, needed: DataFrame, size: int = MARKS) -> DataFrame:
    """The marked rows: all whose key is in ``needed``, and few others."""
    return marked(df, key, needed, size).filter("marked").drop("marked")


def among(df: DataFrame, key: str, needed: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long ``key`` is in ``needed``.

    An inner join with the different keys: a semi join would be moved below the marking,
    and all rows shuffled."""
    return likely(df, key, needed).join(needed.select(key).distinct().hint("merge"), key)


def not_among(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long ``key`` is not in ``gone`` (its only column); null keys stay.
    Rows that aren't marked are not shuffled."""
    name = gone.columns[0]
    keyed = marked(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias(name)), name, gone)
    # an outer join: an anti join would be moved below the marking, and all rows shuffled
    listed = gone.distinct().withColumn("listed", F.lit(True)).hint("merge")
    left = keyed.filter("marked").join(listed, name, "left").filter(F.col("listed").isNull())
    return keyed.filter("not marked").unionByName(left.drop("listed")).select("row.*")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers (a zip sent by Spark itself), so that
    operators run wherever the driver was started from. Once per Spark context."""
    sc = spark.sparkContext
    if not any(f.endswith(PACKAGE_ZIP) for f in sc.listFiles):
        folder = Path(tempfile.mkdtemp(prefix="govlens-zip-"))
        top = Path(__file__).resolve().parents[2]
        with zipfile.ZipFile(folder / PACKAGE_ZIP, "w") as z:
            for f in sorted((top / "govlens").rglob("*.py")):
                z.write(f, f.relative_to(top))
        sc.addPyFile(str(folder / PACKAGE_ZIP))
