"""Near duplicates by HyperMinHash over word shingles.

1. Every text becomes its set of shingle hashes, and that a signature: the hash range is
   cut into buckets, each bucket keeps the smallest value as a register of its number of
   leading zeros and ``MANTISSA`` further bits. Empty buckets are filled by dealing the set
   again, with another hash each time, until none is left.
2. Equal sets are one node from here on (smallest id), however many copies there are.
3. Registers are cut into bands; equal bands put nodes into one bucket. See ``buckets``
   for how components come of them without all pairs of a bucket.
4. A pair is compared by its registers (Jaccard estimate less the collisions to expect),
   and if that comes near the threshold, on the full sets.
5. Links become components by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.buckets import components_of_buckets, shared_buckets
from govlens.llm.common import among, not_among, ship, texts, written
from govlens.llm.words import hashed_words, mix

REGISTERS = 280
MANTISSA = 10
MISS = 1e-6  # highest chance that a pair at the threshold shares no band
SIGMAS = 5  # a pair is dropped when its estimate is so many standard errors below the threshold
MEMBERS = 256  # nodes in a block; members compared with one center in one group of rows
COLUMNS = 8192
DEALT = 2048  # shingles dealt at once to fill empty registers

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EMPTY = np.uint16(0xFFFF)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Registers in a band: the most for which the chance of a miss stays under MISS."""
        j = self.percent / 100
        return max((r for r in range(1, 16) if (1 - j ** r) ** (REGISTERS // r) < MISS), default=1)

    @property
    def bands(self) -> int:
        return REGISTERS // self.rows

    @property
    def least_estimate(self) -> float:
        j = self.percent / 100
        return j - SIGMAS * (j * (1 - j) / REGISTERS) ** 0.5


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``k`` words (A-Z lower-cased, words
    cut at space and \\x09-\\x0D); of fewer words the whole sequence is one; of none, none."""
    w = hashed_words(text)
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ w[i:i + n]) * _M1
            h ^= h >> np.uint64(32)
    return np.unique(mix(h))


def _register(low: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each value."""
    low = low | np.uint64(1)
    bits = np.frexp(low.astype(np.float64))[1]  # may round up to the next power of two: see below
    bits = bits - (low < (np.uint64(1) << (bits - 1).astype(np.uint64)))
    zeros = (64 - bits).astype(np.uint64)
    mantissa = (low << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (np.minimum(zeros, 62) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a non-empty sorted set."""
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = np.full(REGISTERS, _EMPTY, np.uint16)
    out[bucket[starts]] = _register(np.minimum.reduceat(mix(shingles * _M2 + np.uint64(1)), starts))
    return _filled(out, shingles)


def _filled(out: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Each empty register takes the value of the first round of dealing that puts a shingle into
    it. The smallest value that a union of two sets has there in its first such round is any of
    its shingles with equal chance: the sets agree in it with the chance of their similarity,
    however small they are, and registers do not repeat one another."""
    done, rounds = 0, -(-DEALT // len(shingles))
    while len(empty := np.flatnonzero(out == _EMPTY)):
        turn = np.arange(done + 1, done + rounds + 1, dtype=np.uint64)[:, None]
        h = mix(shingles[None, :] ^ mix(turn * _M1))
        place = (h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
        at = (np.arange(rounds)[:, None] * REGISTERS + place.astype(np.int64)).ravel()
        low = np.full(rounds * REGISTERS, _NONE, np.uint64)
        np.minimum.at(low, at, mix(h * _M2 + np.uint64(1)).ravel())
        low = low.reshape(rounds, REGISTERS)[:, empty]
        met = low != _NONE
        ok = met.any(axis=0)
        out[empty[ok]] = _register(low[met.argmax(axis=0)[ok], np.flatnonzero(ok)])
        done += rounds
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers: equal registers, less those to expect equal
    by chance among the unequal ones."""
    same = (a == b).mean(axis=1)
    ratio = 4.0 * n_a * n_b / np.maximum(1, n_a + n_b) ** 2
    chance = 0.17 * 2.0 ** -MANTISSA * ratio
    return (same - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (128-bit hash of the set), sig (registers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for text in batch.column(1):
                x = shingle_set(text.as_py(), s.words)
                d = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                n.append(len(x))
                h1.append(int(d[0]))
                h2.append(int(d[1]))
                sig.append(registers(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(sig, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def banded(nodes: DataFrame, s: Settings) -> DataFrame:
    """(key, id): a row per node and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sig = _matrix(part["sig"])[:, :s.bands * s.rows].astype(np.uint64)
                sig = sig.reshape(-1, s.rows, s.bands)
                key = np.broadcast_to(mix(np.arange(1, s.bands + 1, dtype=np.uint64)), (len(sig), s.bands))
                for r in range(s.rows):
                    key = mix(key + sig[:, r, :])
                ids = np.repeat(part["id"].to_numpy(zero_copy_only=False), s.bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return nodes.select("id", "sig").mapInArrow(run, "key long, id long")


def estimated(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a < b) whose sizes and registers allow the threshold."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch[c].to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
                est = estimate(_matrix(batch["sig_a"]), _matrix(batch["sig_b"]), n_a, n_b)
                yield batch.select(["a", "b"]).filter(pa.array(est >= s.least_estimate))

    fits = 100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b")
    return (pairs.join(side("a"), "a").join(side("b"), "b").filter(fits)
            .select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs that reach the threshold on their full sets.

    Pairs are grouped by ``a`` in chunks of about MEMBERS, so that a node with any number of
    partners is spread; rows of a chunk pass as a sorted stream, the center's text first."""
    size = pairs.groupBy("a").agg(F.count("*").alias("m"))
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / MEMBERS))
    pairs = pairs.join(size, "a").select("a", "b", chunk.cast("long").alias("chunk"))
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    full = written(among(docs, "doc_id", needed), "candidates")
    center = pairs.select("a", "chunk").distinct().join(
        full.select(F.col("doc_id").alias("a"), "text"), "a").select(
        "a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    member = pairs.join(full.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "chunk", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centers = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, c, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = shingle_set(text, s.words)
                if (a, c) != now:
                    now, centers = (a, c), []
                if b is None:
                    centers.append(own)
                elif any(similar(x, own, s.percent) for x in centers):
                    out.append((a, b))
            yield _link_batch(out)

    return (center.union(member).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
            .mapInArrow(run, "a long, b long"))


def full_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """id and s, the shingle hashes of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = [shingle_set(t.as_py(), s.words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], ["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: their 0/1 matrix times its transpose,
    a bounded number of columns at a time. Elements of one set only are left out."""
    n = len(sets)
    element, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    shared = count > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    columns = int(shared.sum())
    for lo in range(0, columns, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((n, min(COLUMNS, columns - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def _new_links(ids: list[int], components: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between different components among the sets of one group, as few as join them."""
    both = shared_counts(sets).astype(np.int64)
    size = np.array([len(x) for x in sets])
    linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
    names = np.array(components)
    linked &= names[:, None] != names[None, :]
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while top.get(c, c) != c:
            c = top[c]
        return c

    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = root(components[i]), root(components[j])
        if a != b:
            top[max(a, b)] = min(a, b)
            yield ids[i], ids[j]


def linked_across(mixed: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between different components within the buckets of ``mixed``.

    A bucket is dealt into blocks of about MEMBERS nodes, and each pair of blocks is a group
    of rows of its own: no group grows with the bucket, and only links leave it."""
    blocks = mixed.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = mixed.join(blocks, "key").select("key", "id", "component", own.alias("own"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).select(
        "key", "id", "component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    rows = dealt.join(written(sets, "sets"), "id").select("key", "lo", "hi", "id", "component", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, components, own = None, [], [], []
        for batch in batches:
            links: list[tuple[int, int]] = []
            heads = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for r, (key, lo, hi, i, c) in enumerate(heads):
                if (key, lo, hi) != now:
                    if len(ids) > 1:
                        links += _new_links(ids, components, own, s.percent)
                    now, ids, components, own = (key, lo, hi), [], [], []
                ids.append(i)
                components.append(c)
                own.append(batch.column(5)[r].values.to_numpy(zero_copy_only=False))
            yield _link_batch(links)
        if len(ids) > 1:
            yield _link_batch(list(_new_links(ids, components, own, s.percent)))

    return (rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(run, "a long, b long").distinct())


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= ``percent`` * union of their shingle sets.
    component_id is the smallest doc_id reachable, kept means doc_id = component_id. Null and
    empty texts have an empty set and are linked with nothing. Rows that share an id count as
    one document. Rows without an id are linked with nothing (component_id and kept null).
    Other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    s = Settings(words, percent)
    rows = texts(docs, id_col, text_col)
    sets = written(signatures(rows, s), "signatures")
    known = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = written(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("id")), "first-of-equal")
    nodes = written(known.join(first.select("h1", "h2", F.col("id").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
                    .dropDuplicates(["h1", "h2", "doc_id"]).select(F.col("doc_id").alias("id"), "n", "sig"), "nodes")
    groups = components_of_buckets(
        shared_buckets(banded(nodes, s)), lambda pairs: verified(written(estimated(pairs, nodes, s), "pairs"), rows, s),
        lambda mixed: linked_across(mixed, full_sets(among(rows, "doc_id", mixed.select(
            F.col("id").alias("doc_id")).distinct()), s), s))
    of = first.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "h1", "h2", F.coalesce("component", "id").alias("component_id"))
    linked = sets.withColumn("n1", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("h1")))
    out = linked.join(of.withColumnRenamed("h1", "n1"), ["n1", "h2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("doc_id") == component).alias("kept"))


def kept_of_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                            text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, and all
    rows without an id. Columns are those of ``docs``."""
    gone = near_duplicates(docs, words, percent, id_col, text_col).filter(~F.col("kept")).select(
        F.col("doc_id").alias("gone")).distinct()
    return not_among(docs, F.col(f"`{id_col}`").cast("long"), written(gone, "near-duplicates"))
