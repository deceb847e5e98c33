"""Numbers for words: blocks of documents carry their own word lists, a corpus-wide dictionary
gives each different word a number, and each block gets the numbers of its words back.

Only words that differ within a block are ever shuffled, never a word per occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import written

_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df``, written, with ``column``: numbers from 0 without gaps, one per row.

    Only the row count of each written partition meets in one place, to give where that
    partition's numbers start."""
    rows = written(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["_part"], at))
        at += r["n"]
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(column, F.col("_start") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1))
            .drop("_part", "_start", "_at"))


def numbered_words(blocks: DataFrame) -> DataFrame:
    """(block, place, word, number) of every word of the blocks' lists; equal words have one number.

    One shuffle brings the rows of a word together, at most one per block; the number is that of
    the word's first row in the order of its partition, which any rerun repeats."""
    each = blocks.select("block", F.posexplode("words").alias("place", "word"))
    rows = each.repartition("word").sortWithinPartitions("word", "block").withColumn("_at", F.monotonically_increasing_id())
    return rows.select("block", "place", "word", F.min("_at").over(Window.partitionBy("word")).alias("number"))


def by_block(found: DataFrame) -> DataFrame:
    """block, ``places`` and ``numbers`` of rows (block, place, number). A block's list is bounded by
    the block's size."""
    lists = found.groupBy("block").agg(F.collect_list(F.struct("place", "number")).alias("m"))
    return lists.select("block", F.col("m.place").alias("places"), F.col("m.number").alias("numbers"))


def numbers_of_blocks(blocks: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`by_block` of the blocks' words that the dictionary (``keys``, number) has."""
    extra = [k for k in keys if k != "word"]
    each = blocks.select("block", *extra, F.posexplode("words").alias("place", "word"))
    return by_block(each.join(dictionary.select(*keys, "number"), keys))
