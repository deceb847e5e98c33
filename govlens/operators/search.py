"""Catalog search by an index of name parts, for catalogs that are too large to scan for each search.

The index has two tables, both partitioned so that a search reads only the folders it needs:
``grams`` (three characters in a row -> the different names that hold them) and ``rows`` (name -> catalog
rows that have it in any field). Names repeat far more often than they differ, so parts are
kept per name, not per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("database_name", "schema_name", "table_name", "column_name")
SIZE = 3
FOLDERS = 64


def _folder(key: str | Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int").alias("folder")


def _parts(name: Column) -> Column:
    """The different runs of ``SIZE`` characters of a name; none of a shorter one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - (SIZE - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substr(name, i, F.lit(SIZE))), lambda g: F.length(g) == SIZE))


def _names() -> Column:
    """The row's different names in lower case, in the order of the fields."""
    return F.array_distinct(F.array_compact(F.array(*[F.lower(f) for f in FIELDS])))


def write_search_index(catalog: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Write the index of ``catalog`` (its name fields) to ``path``.

    ``folders`` bounds the folders of each table; size it so that one holds a few hundred MB. Ids are not
    stored: a row is there once for each of its names, so hashes would be most of the index."""
    rows = catalog.select(*FIELDS, F.explode(_names()).alias("name"))
    rows = rows.withColumn("folder", _folder("name", folders))
    grams = rows.select("name").distinct().select("name", F.explode(_parts(F.col("name"))).alias("gram"))
    grams = grams.withColumn("folder", _folder("gram", folders))
    for df, key, name in ((rows, "name", "rows"), (grams, "gram", "grams")):
        # by folder and a few splits of it, so that a very common name is no single task
        (df.repartition(folders * 2, "folder", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(2))).sortWithinPartitions("folder", key)
         .write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/{name}"))


def matching_names(spark: SparkSession, path: str, pattern: str, folders: int = FOLDERS) -> DataFrame:
    """(name): the different lower-cased names that contain ``pattern``.

    Names that hold all of the pattern's parts are checked by ``contains``. A pattern shorter than a part
    has none: then the different names of ``rows`` are checked."""
    p = pattern.lower()
    wanted = sorted({p[i:i + SIZE] for i in range(len(p) - SIZE + 1)})
    if not wanted:
        return spark.read.parquet(f"{path}/rows").select("name").distinct().filter(F.col("name").contains(p))
    one = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in wanted])).alias("gram"))
    places = sorted({r[0] for r in one.select(_folder("gram", folders)).collect()})
    found = spark.read.parquet(f"{path}/grams").filter(F.col("folder").isin(places) & F.col("gram").isin(wanted))
    return (found.groupBy("name").agg(F.count("*").alias("n")).filter((F.col("n") == len(wanted)) & F.col("name").contains(p))
            .select("name"))


def indexed_search(spark: SparkSession, path: str, pattern: str, folders: int = FOLDERS) -> DataFrame:
    """Catalog rows with a field that contains ``pattern`` (any case), as ``catalog_search`` gives them."""
    names = matching_names(spark, path, pattern, folders).withColumn("folder", _folder("name", folders))
    rows = spark.read.parquet(f"{path}/rows").join(names, ["folder", "name"], "left_semi")
    # a row may match by several of its names: it is taken by the first of them
    first = F.get(F.filter(_names(), lambda n: n.contains(pattern.lower())), F.lit(0))
    return rows.filter(F.col("name") == first).select(*FIELDS)
