"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node. Nodes carry a code (a signed byte per component
and a scale); graph and search use scores of codes, and the last word has the exact product.

Graph (a table of edges u, v, score, fresh; at most ``K`` a node):

1. Start: nodes meet in groups, of similar ones by the signs of a few random projections, and of
   random ones. Groups larger than ``GROUP`` are dealt into several. In a group each node takes
   its best neighbours.
2. Rounds: at each node the neighbours meet (those it has, and those that have it; ``SAMPLE`` fresh
   and ``SAMPLE`` older ones, dealt anew each round), and pairs that beat a node's worst neighbour
   become edges. Only pairs with a fresh edge are compared. Rounds end when few edges are fresh.

For the graph a vector gets one more component, so that all have the largest norm: then nearest by
angle is nearest by inner product with a query, whose own is 0 in the search.

Search: every query starts at its own node and a few of the largest norms, and expands in each round its
best ``WIDTH`` nodes that are not expanded yet, within its best ``POOL``. It ends when a round
improves none of its best. A node's row holds its neighbours' codes, in a table bucketed by node, so
that a round shuffles the requests only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govlens.llm.common import new_path, ship, written
from govlens.llm.dictionary import numbered

K, SAMPLE, JOINED = 32, 24, 8  # neighbours of a node; those that meet; new pairs a node takes from one meeting
GROUP, PROJECTIONS = 64, 4  # nodes in a starting group; groupings by projections
FRESH_PERCENT, ROUNDS = 12, 16  # the graph is done when no more of its edges are fresh, or after so many rounds
WIDTH, POOL, ENTRIES = 64, 512, 8
DEGREE = 48  # neighbours that a node's row holds for the search
TOP, EVERY = 20, 20


# ------------------------------------------------------------------ nodes

def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and vec (array of double) of the rows that take part.

    Rows without an id or a vector, vectors with a null or non-finite component, zero vectors, and
    those of another length than most (ties: the shorter) take no part."""
    v = F.col("vec")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows"))
    return rows.join(sizes.orderBy(F.desc("rows"), "n").limit(1).select("n"), F.size("vec") == F.col("n")).drop("n")


NODES = "id long, code binary, scale double, extra double, key array<long>, norm double"
_NODES = pa.schema([("id", pa.int64()), ("code", pa.binary()), ("scale", pa.float64()), ("extra", pa.float64()),
                    ("key", pa.list_(pa.int64())), ("norm", pa.float64())])


def nodes_of(classes: DataFrame, largest: float, bits: int) -> DataFrame:
    """Code and scale of each vector of ``classes`` (id, vec), the component that lengthens it, the
    lengthened vector's signs under the projections, and the vector's norm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norm = np.sqrt((vec * vec).sum(1))
            extra = np.sqrt(np.maximum(largest * largest - norm * norm, 0))
            long = np.concatenate([vec, extra[:, None]], 1)
            planes = np.random.default_rng(7).standard_normal((PROJECTIONS * bits, long.shape[1]))
            signs = ((long @ planes.T) > 0).reshape(len(vec), PROJECTIONS, bits)
            keys = signs @ (1 << np.arange(bits, dtype=np.int64))
            scale = np.abs(vec).max(1) / 127
            code = np.rint(vec / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(extra),
                 pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64())), pa.array(norm)], schema=_NODES)

    return classes.select("id", "vec").mapInArrow(run, NODES)


def _codes(column: pa.Array, n: int) -> np.ndarray:
    """Codes of one length as a matrix of floats, whose products are exact."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1]
    flat = np.frombuffer(column.buffers()[2], np.int8)[ends[0]:ends[-1]]
    return flat.reshape(n, -1).astype(np.float32 if len(flat) // n <= 1024 else np.float64)


# ------------------------------------------------------------------ graph

_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("score", pa.float64())])
PAIRS = "u long, v long, score double"


def _best_pairs(who: np.ndarray, code: np.ndarray, scale: np.ndarray, extra: np.ndarray, worst: np.ndarray,
                fresh: np.ndarray, take: int):
    """Of the nodes met at one place, each one's best others that beat its worst neighbour;
    one of a pair is fresh."""
    who, first = np.unique(who, return_index=True)
    if len(who) < 2:
        return None
    code, scale, extra, worst, fresh = code[first], scale[first], extra[first], worst[first], fresh[first]
    # exact products of codes, then one order of operations: a pair scores the same wherever it meets
    score = (code @ code.T).astype(np.float64) * (scale[:, None] * scale[None, :]) + extra[:, None] * extra[None, :]
    score[~(fresh[:, None] | fresh[None, :])] = -np.inf
    np.fill_diagonal(score, -np.inf)
    take = min(take, len(who) - 1)
    best = np.argpartition(-score, take - 1, 1)[:, :take]
    found = np.take_along_axis(score, best, 1)
    keep = found > worst[:, None]
    u, at = np.nonzero(keep)
    return who[u], who[best[u, at]], found[u, at]


def meetings(lists: DataFrame, take: int) -> DataFrame:
    """New edges (u, v, score) from meetings: rows with arrays of the structs of nodes ``m``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, out = batch["m"], []
            ends = np.frombuffer(m.buffers()[1], np.int32)[m.offset:m.offset + len(m) + 1]
            flat = m.values
            if ends[-1] == ends[0]:
                continue
            who, scale, extra, worst, fresh = (flat.field(n).to_numpy(zero_copy_only=False)
                                               for n in ("who", "scale", "extra", "worst", "fresh"))
            code = flat.field("code")
            for lo in range(0, len(m), 512):
                a, z = ends[lo], ends[min(lo + 512, len(m))]
                if z == a:
                    continue
                codes = _codes(code[a:z], z - a)
                for i in range(lo, min(lo + 512, len(m))):
                    s, e = ends[i], ends[i + 1]
                    pairs = _best_pairs(who[s:e], codes[s - a:e - a], scale[s:e], extra[s:e], worst[s:e], fresh[s:e], take)
                    if pairs is not None:
                        out.append(pairs)
            if out:
                u, v, score = (np.concatenate(x) for x in zip(*out, strict=True))
                # one pair is met at several places
                order = np.lexsort((v, u))
                u, v, score = u[order], v[order], score[order]
                new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (u, v, score)], schema=_PAIRS)

    return lists.select("m").mapInArrow(run, PAIRS)


def _met(members: DataFrame, nodes: DataFrame, worst: DataFrame | None) -> DataFrame:
    """``m`` per place: of ``members`` (at, who, fresh) with the nodes' codes."""
    facts = nodes.select(F.col("id").alias("who"), "code", "scale", "extra")
    if worst is not None:
        facts = facts.join(worst, "who", "left")
    else:
        facts = facts.withColumn("worst", F.lit(None).cast("double"))
    low = F.coalesce("worst", F.lit(float("-inf")))
    return members.join(facts, "who").groupBy("at").agg(F.collect_list(
        F.struct("who", "fresh", low.alias("worst"), "code", "scale", "extra")).alias("m"))


def _start(nodes: DataFrame, n: int) -> DataFrame:
    """Members of the starting groups: at, who, fresh."""
    groups = max(1, round(n / GROUP))
    keys = F.concat(F.transform("key", lambda k, i: F.concat_ws(":", i, k)),
                    F.array(F.concat(F.lit("any:"), F.pmod(F.xxhash64("id"), F.lit(groups)))))
    each = nodes.select(F.col("id").alias("who"), F.explode(keys).alias("key"))
    sizes = each.groupBy("key").agg(F.ceil(F.count("*") / (2 * GROUP)).alias("blocks"))
    own = F.pmod(F.xxhash64("who", "key"), F.col("blocks"))
    return each.join(sizes, "key").select(F.concat_ws("/", "key", own).alias("at"), "who", F.lit(True).alias("fresh"))


def _merged(edges: DataFrame | None, new: DataFrame, k: int) -> DataFrame:
    """Each node's best ``k`` different neighbours of both; a pair found again is not fresh."""
    both = new.withColumn("fresh", F.lit(True))
    if edges is not None:
        both = edges.withColumn("fresh", F.lit(False)).unionByName(both)
    order = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    ranked = both.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return ranked.groupBy("u", "v").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))


def neighbour_graph(nodes: DataFrame, n: int, k: int = K, sample: int = SAMPLE, fresh_percent: int = FRESH_PERCENT,
                    rounds: int = ROUNDS) -> DataFrame:
    """Edges (u, v, score, fresh) to each node's ``k`` nearest found by NN-descent."""
    edges = written(_merged(None, meetings(_met(_start(nodes, n), nodes, None), k), k), "edges")
    for i in range(rounds):
        both = edges.select(F.col("u").alias("at"), F.col("v").alias("who"), "fresh").union(
            edges.select(F.col("v").alias("at"), F.col("u").alias("who"), "fresh"))
        deal = Window.partitionBy("at", "fresh").orderBy(F.xxhash64("at", "who", F.lit(i)), "who")
        members = both.withColumn("rank", F.row_number().over(deal)).filter(F.col("rank") <= sample).drop("rank")
        worst = edges.groupBy(F.col("u").alias("who")).agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        worst = worst.filter(F.col("n") >= k).select("who", "worst")
        met = _met(members, nodes, worst).filter(F.exists("m", lambda x: x["fresh"]))
        edges = written(_merged(edges, meetings(met, JOINED), k), "edges")
        fresh, all_edges = edges.agg(F.count_if("fresh"), F.count("*")).first()
        if 100 * fresh <= fresh_percent * all_edges:
            break
    return edges


# ------------------------------------------------------------------ search

STATE = ("query long, code binary, scale double, ids array<long>, scores array<double>, open array<boolean>, "
         "expand array<long>, worst double, best double, done boolean")
_STATE = pa.schema([("query", pa.int64()), ("code", pa.binary()), ("scale", pa.float64()), ("ids", pa.list_(pa.int64())),
                    ("scores", pa.list_(pa.float64())), ("open", pa.list_(pa.bool_())), ("expand", pa.list_(pa.int64())),
                    ("worst", pa.float64()), ("best", pa.float64()), ("done", pa.bool_())])
_FOUND = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def adjacency(edges: DataFrame, nodes: DataFrame, degree: int = DEGREE) -> DataFrame:
    """Per node the ids, codes and scales of its best ``degree`` neighbours in either direction, and its own."""
    both = edges.select(F.col("u").alias("at"), F.col("v").alias("who"), "score").union(
        edges.select(F.col("v").alias("at"), F.col("u").alias("who"), "score"))
    order = Window.partitionBy("at").orderBy(F.desc("score"), "who")
    near = (both.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= degree)
            .select("at", "who").distinct().union(nodes.select(F.col("id").alias("at"), F.col("id").alias("who"))))
    facts = nodes.select(F.col("id").alias("who"), "code", "scale")
    return near.join(facts, "who").groupBy("at").agg(F.collect_list(F.struct("who", "code", "scale")).alias("m"))


def _bucketed(df: DataFrame, key: str, buckets: int) -> tuple[str, DataFrame]:
    table = f"neighbours_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", new_path(df.sparkSession, "neighbours")).saveAsTable(table))
    return table, df.sparkSession.table(table)


def _expanded(requests: DataFrame, near: DataFrame) -> DataFrame:
    """Per request (query, code, scale, worst, at): the neighbours of ``at`` and their scores, those
    that may enter the query's pool."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            queries = _codes(batch["code"], n)
            q, q_scale, worst = (batch[c].to_numpy(zero_copy_only=False) for c in ("query", "scale", "worst"))
            m = batch["m"]
            ends = np.frombuffer(m.buffers()[1], np.int32)[m.offset:m.offset + n + 1]
            who, scale = (m.values.field(c).to_numpy(zero_copy_only=False) for c in ("who", "scale"))
            out = []
            for i in range(n):
                s, e = ends[i], ends[i + 1]
                score = (_codes(m.values.field("code")[s:e], e - s) @ queries[i]).astype(np.float64) * (scale[s:e] * q_scale[i])
                keep = score > worst[i]
                if keep.any():
                    out.append((q[i], who[s:e][keep], score[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return requests.join(near, "at").select("query", "code", "scale", "worst", "m").mapInArrow(
        run, "query long, ids array<long>, scores array<double>")


def _advanced(state: DataFrame, found: DataFrame, width: int, pool: int, top: int) -> DataFrame:
    """The queries' pools with what their requests found, and what they expand next."""
    lists = found.groupBy("query").agg(F.collect_list("ids").alias("new_ids"), F.collect_list("scores").alias("new_scores"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: batch[n] for n in batch.schema.names}
            out = []
            for i in range(batch.num_rows):
                def values(name: str, kind) -> np.ndarray:
                    x = rows[name][i]
                    if not x.is_valid:
                        return np.zeros(0, kind)
                    x = x.values.flatten() if name.startswith("new_") else x.values
                    return x.to_numpy(zero_copy_only=False).astype(kind)

                ids = np.concatenate([values("ids", np.int64), values("new_ids", np.int64)])
                scores = np.concatenate([values("scores", np.float64), values("new_scores", np.float64)])
                old = values("open", bool)
                is_open = np.concatenate([old, np.ones(len(ids) - len(old), bool)])
                ids, first = np.unique(ids, return_index=True)  # of one id the first, which knows if it is expanded
                scores, is_open = scores[first], is_open[first]
                order = np.lexsort((ids, -scores))[:pool]
                ids, scores, is_open = ids[order], scores[order], is_open[order]
                best = float(scores[:top + 1].sum())
                before = rows["best"][i].as_py()
                more = np.flatnonzero(is_open)[:width]
                done = not len(more) or (before is not None and best <= before and len(ids) > top)
                expand = ids[more]
                is_open[more] = False
                worst = float(scores[-1]) if len(ids) >= pool else float("-inf")
                out.append((rows["query"][i].as_py(), rows["code"][i].as_py(), rows["scale"][i].as_py(), ids, scores, is_open,
                            expand, worst, best, done))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _STATE, strict=True)], schema=_STATE)

    return state.join(lists, "query", "left").mapInArrow(run, STATE)


def search(queries: DataFrame, near: DataFrame, entries: list[int], width: int = WIDTH, pool: int = POOL, top: int = TOP) -> DataFrame:
    """(query, ids): the pools of ``queries`` (query: a node; code, scale), best first."""
    state = written(queries.select(
        "query", "code", "scale", F.expr("array()").cast("array<long>").alias("ids"), F.expr("array()").cast("array<double>").alias("scores"),
        F.expr("array()").cast("array<boolean>").alias("open"),
        F.array_distinct(F.concat(F.array("query"), F.array(*[F.lit(e) for e in entries]).cast("array<long>"))).alias("expand"),
        F.lit(float("-inf")).alias("worst"), F.lit(None).cast("double").alias("best"), F.lit(False).alias("done")), "search")
    ended = []
    while True:
        requests = state.select("query", "code", "scale", "worst", F.explode("expand").alias("at"))
        state = written(_advanced(state, _expanded(requests, near), width, pool, top), "search")
        ended.append(state.filter("done").select("query", "ids"))
        state = state.filter("not done")
        if state.isEmpty():
            break
    out = ended[0]
    for more in ended[1:]:
        out = out.union(more)
    return out


# ------------------------------------------------------------------ operator

def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, every: int = EVERY,
            k: int = K, width: int = WIDTH, pool: int = POOL) -> DataFrame:
    """For each row whose id is divisible by ``every`` its ``top`` nearest other rows found:
    query_id, rank (from 1), vec_id, score (exact inner product), ties to the smaller vec_id.

    Null, zero and non-finite vectors take no part (see :func:`valid_vectors`); an empty table gives an
    empty result. Equal vectors are one node in the graph, of which the ``top`` + 1 smallest ids are
    all that a result can need. Rows that share an id and a vector count once; of those that share
    an id only, each is a candidate. Other columns are not read."""
    spark: SparkSession = df.sparkSession
    ship(spark)
    rows = written(valid_vectors(df, id_col, vec_col).distinct(), "vectors")
    n, largest = rows.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = Window.partitionBy("vec").orderBy("vec_id")
    firsts = rows.withColumn("nth", F.row_number().over(rank)).filter(F.col("nth") <= top + 1)
    members = firsts.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = numbered(members, "id", "classes")
    n = classes.count()
    bits = max(0, round(np.log2(max(n / GROUP, 1))))
    nodes = written(nodes_of(classes, float(np.sqrt(largest)), bits), "nodes")
    edges = neighbour_graph(nodes, n, k)
    buckets = max(8, -(-n * DEGREE * 100 // (64 << 20)))
    table, near = _bucketed(adjacency(edges, nodes), "at", buckets)
    asked = rows.filter(F.col("vec_id") % every == 0).join(classes.select("vec", "id"), "vec").select("vec_id", "id")
    asked = written(asked, "queries")
    entries = [r.id for r in nodes.orderBy(F.desc("norm"), "id").limit(ENTRIES).collect()]
    queries = asked.select("id").distinct().join(nodes.select("id", "code", "scale"), "id").withColumnRenamed("id", "query")
    found = written(search(queries, near, entries, width, pool, top), "found")
    spark.sql(f"DROP TABLE {table}")
    exact = _exact(found.select("query", F.explode(F.slice("ids", 1, 3 * top + 4)).alias("id")), classes, top)
    best = asked.withColumnRenamed("id", "query").join(exact, "query").filter(F.col("member") != F.col("vec_id"))
    order = Window.partitionBy("vec_id", "query").orderBy(F.desc("score"), "member")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(F.col("vec_id").alias("query_id"), "rank", F.col("member").alias("vec_id"), "score")


def _exact(pairs: DataFrame, classes: DataFrame, top: int) -> DataFrame:
    """query, score and member (a vec_id) of each query's best classes by the exact product. A class ranks
    by its smallest id, so ``top`` + 1 classes hold all of the ``top`` nearest."""
    a, b = classes.select(F.col("id").alias("query"), F.col("vec").alias("a")), classes.select("id", F.col("vec").alias("b"), "ids")
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(b, "id").join(a, "query").select("query", "ids", product.alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    kept = scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top + 1)
    return kept.select("query", "score", F.explode("ids").alias("member"))
