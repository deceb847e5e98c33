"""How corpus filters interact: what each removes in every order of application.

A and B are read off a sparse document-term matrix (``term_matrix``): a row's sum is the
document's number of words, its nonzero entries are the different ones. C, D and the text's
digest are attached when a block of documents is read. E compares digests table-wide.

Documents become a number of rows per (part, labels, failed filters): at most 128 a part. All
orders are read off those, so no order is ever run over the documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import written
from govlens.llm.dictionary import numbered_words
from govlens.llm.term_matrix import BLOCK_BYTES, row_totals, word_blocks

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 100, 80, 10, "#$%&*|"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, part, digest and ``fails`` (bits of A to D) per row of ``docs``.

    A null text is empty, a null part the empty string. A document without words fails A and C or D
    by its characters alone, never B."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    blocks = word_blocks(rows, SYMBOLS, block_bytes)
    totals = row_totals(blocks, numbered_words(blocks))
    tests = {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"),
        "C": 100 * F.col("n_upper") > UPPER_PERCENT * F.col("n_chars"),
        "D": F.col("symbol"),
    }
    bits = sum((F.when(t, _bit(k)).otherwise(0) for k, t in tests.items()), F.lit(0))
    return totals.select("doc_id", "part", "digest", bits.alias("fails"))


def counted_failures(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, n_good and n_toxic: documents by what they fail.

    E: a document fails where a smaller doc_id has its digest. Equal rows (digest, part, doc_id) are
    one with a count before anything is joined or compared, and a digest's rows are one per part
    and label before they meet, so neither a text of very many copies nor a repeated id lands in
    one task. A document of several labels is good or toxic where one of them says so; without an
    id it has no label, no smaller id and is no smaller id itself."""
    rows = written(found.groupBy("digest", "part", "fails", "doc_id").agg(F.count("*").alias("n")), "audited")
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    with_id = rows.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    without = rows.filter(F.col("doc_id").isNull()).withColumns({"good": no, "toxic": no})
    groups = with_id.unionByName(without).groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    smallest = F.min("first").over(Window.partitionBy("digest"))
    split = groups.withColumn("clean", F.col("n_null") + F.when(
        F.col("first") == smallest, F.coalesce("n_first", F.lit(0))).otherwise(0))
    sides = split.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("fails").alias("fails"), F.col("clean").alias("n")),
        F.struct((F.col("fails") + _bit("E")).alias("fails"), (F.col("n") - F.col("clean")).alias("n")))).alias("s"))
    return sides.select("part", "good", "toxic", "s.fails", "s.n").groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))


def _with_steps(parts: DataFrame) -> DataFrame:
    """Each row 600 times: filter_order, step, its filter's bit and the bits of the filters before it."""
    orders = F.split(F.lit(",".join("".join(o) for o in permutations(FILTERS))), ",")
    each = parts.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bit(place: Column) -> Column:
        letter = F.substr("filter_order", place, F.lit(1))
        return F.element_at(F.create_map(*[F.lit(x) for k in FILTERS for x in (k, _bit(k))]), letter)

    before = sum((F.when(F.col("step") > i, bit(F.lit(i))).otherwise(0) for i in range(1, len(FILTERS))), F.lit(0))
    return each.withColumns({"bit": bit(F.col("step")), "before": before})


def interactions(counts: DataFrame) -> DataFrame:
    """The audit from :func:`counted_failures`: a row per part, filter order and step.

    A filter's ``shapley`` counts a document in the orders that put it before all other filters that
    the document fails: 120 divided by how many it fails."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "n_good", "n_toxic")).alias("m"))
    each = _with_steps(parts)

    def total(body) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + body(x))

    def hits(x: Column) -> Column:
        return x["fails"].bitwiseAND(F.col("bit")) != 0

    def earlier(x: Column) -> Column:
        return x["fails"].bitwiseAND(F.col("before")) != 0

    def when(cond: Column, value: Column) -> Column:
        return F.when(cond, value).otherwise(0)

    orders = F.lit(factorial(len(FILTERS)))
    share = lambda x: F.call_function("div", x["n"] * orders, F.bit_count(x["fails"]).cast("long"))
    return each.select(
        "part", "filter_order", "step",
        total(lambda x: when(x["fails"].bitwiseAND(F.col("before") + F.col("bit")) == 0, x["n"])).alias("kept"),
        total(lambda x: when(hits(x) & ~earlier(x), x["n"])).alias("removed"),
        total(lambda x: when(hits(x) & earlier(x), x["n"])).alias("redundant"),
        total(lambda x: when(x["fails"] == F.col("bit"), x["n"])).alias("unique_fails"),
        total(lambda x: when(hits(x) & ~earlier(x), x["n_good"])).alias("good_lost"),
        total(lambda x: when(hits(x) & ~earlier(x), x["n_toxic"])).alias("toxic_lost"),
        total(lambda x: when(hits(x), share(x))).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Filter interaction audit of ``docs`` (doc_id, text, lang; others ignored) with ``labels``
    (doc_id, quality, toxic): a row per part, order of the five filters and step.

    Null texts are empty texts and null languages the part ''. Repeated rows count as often as they
    occur. Without documents there is no part, hence no row. A text of any length is one row of
    the matrix. Extra columns, whatever their names, are not read."""
    return interactions(written(counted_failures(failures(docs, block_bytes=block_bytes), labels), "audit-counts"))
