"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the
    smallest node that can be reached. Loops and null ends are ignored.

    Alternating large-star and small-star steps: each hangs neighbours below the smallest
    one near them, until every component is a star around its smallest node, in a number
    of rounds logarithmic in the nodes. A step is a minimum per node (combined before the
    shuffle, so that a node of any degree is one row per task) and an equi-join. Every round is
    written to the shared folder, so a lost executor costs at most one round.
    """
    up = written(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(up)
    while True:
        up = written(_small_star(_large_star(up)), "edges")
        before, state = state, _state(up)
        if state == before:
            break
    roots = up.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return up.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _large_star(up: DataFrame) -> DataFrame:
    both = up.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
        up.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.join(low, "x").filter(F.col("y") > F.col("x")).select(
        F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(up: DataFrame) -> DataFrame:
    low = up.groupBy("u").agg(F.min("v").alias("m"))
    moved = up.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(up: DataFrame) -> tuple:
    """Count and hash of the edges: equal when a round changed nothing."""
    return tuple(up.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.hash("u", "v"), F.lit(1009)))).first())
