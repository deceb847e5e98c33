"""From buckets of nodes to components, without a bucket's pairs.

First every node is compared with the smallest and the largest node of its buckets: two
pairs a node. What that links is one component, and only buckets whose nodes are in
different components by then stay open: only their nodes are compared any further, by
the operator's own means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import dropped, written
from govlens.llm.components import connected_components


def _ordered(x: str, y: str):
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _of_several(buckets: DataFrame) -> DataFrame:
    """The rows (key, id, ...) of buckets of several nodes, with the bucket's lo and hi (smallest and
    largest id) and its number of nodes.

    One shuffle of the rows by key, whatever share of the keys is met twice: a broadcast filter
    of keys met twice lets ever more rows pass as they become many."""
    same = Window.partitionBy("key")
    return buckets.withColumns({"lo": F.min("id").over(same), "hi": F.max("id").over(same),
                                "nodes": F.count("*").over(same)}).filter(F.col("lo") < F.col("hi"))


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """key, id, lo and hi (smallest and largest id of the bucket) of all buckets (key, id) of
    several nodes."""
    return written(_of_several(buckets).drop("nodes"), "members")


def met_buckets(buckets: DataFrame, may_link: Callable[[Column, Column], Column], most: int,
                nodes: DataFrame | None = None) -> DataFrame:
    """As :func:`shared_buckets`, for buckets (key, id, of) with a short description ``of`` of each node,
    without the nodes that ``may_link`` rules out for all others of their bucket.

    ``nodes`` (id, of) spares moving the descriptions of nodes that share no bucket: ``buckets`` is (key, id)
    then. In buckets of more than ``most`` nodes, whose pairs are too many for one task, all nodes
    stay. Nothing that can be linked goes."""
    several = written(_of_several(buckets).drop("lo", "hi"), "shared-buckets")
    found = several if nodes is None else several.join(nodes.hint("merge"), "id")
    small = found.filter(F.col("nodes") <= most)
    x, y = small.alias("x"), small.alias("y").hint("merge")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & may_link(
        F.col("x.of"), F.col("y.of")), "left_semi").select("key", "id")
    left = written(met.union(several.filter(F.col("nodes") > most).select("key", "id")), "met-buckets")
    ends = left.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    members = written(left.join(ends, "key"), "members")
    dropped(several, left)
    return members


def components_of_buckets(members: DataFrame, links_of: Callable[[DataFrame], DataFrame],
                          links_across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of the nodes that are linked with another.

    ``members``: :func:`shared_buckets`. ``links_of`` takes distinct pairs a < b and gives
    those that are linked. ``links_across`` takes the open buckets (key, id, component) and
    gives all links in them between different components."""
    groups, mixed = _by_ends(members, links_of)
    if mixed.isEmpty():
        return groups
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(stars.union(links_across(mixed)))


def components_in_rounds(members: DataFrame, links_of: Callable[[DataFrame], DataFrame],
                         some_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As :func:`components_of_buckets`, but with few links at a time: ``some_links`` takes the
    open buckets and gives (key, a, b), for each component a of each bucket at least one
    linked component b of this bucket, if there is any.

    What a round links is merged before the next, so at least half of the components that can
    be linked are gone after it. A bucket without a link, or with one component left, is done;
    of buckets with the same members one is enough."""
    groups, mixed = _by_ends(members, links_of)
    mixed = written(different_buckets(mixed), "open")
    edges = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    while not mixed.isEmpty():
        links = written(some_links(mixed), "links")
        edges = edges.union(links.select("a", "b").distinct())
        merged = written(connected_components(links), "merged").select(
            F.col("node").alias("component"), F.col("component").alias("root"))
        linked = mixed.join(links.select("key").distinct(), "key")
        mixed = mixed_buckets(linked.join(merged, "component", "left").select(
            "key", "id", F.coalesce("root", "component").alias("component")))
    return connected_components(edges)


def _by_ends(members: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Components by comparing every node with the ends of its buckets, and the buckets still open."""
    reach = members.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pairs = (reach.select(F.explode(F.array(_ordered("id", "lo"), _ordered("id", "hi"))).alias("p")).select("p.*")
             .filter(F.col("a") < F.col("b")).distinct())
    groups = written(connected_components(links_of(pairs)), "components")
    mixed = mixed_buckets(members.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")))
    return groups, mixed


def different_buckets(mixed: DataFrame) -> DataFrame:
    """One bucket of those with the same members, told by their number and two 64-bit sums of hashes."""
    prints = mixed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                      F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    return mixed.join(prints.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")


def mixed_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter(
        F.col("lo") < F.col("hi")).select("key")
    return written(members.join(keys, "key"), "mixed")
