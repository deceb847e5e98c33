"""Language-model scores by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of the bigram, the unigram and
the uniform distribution; the weights depend on how often the context occurs (a bucket
per power of two) and are learned by expectation-maximisation on a part of the training
documents, each token of which is deleted from the counts that estimate it (leave one out).
Held-out documents are in no count and in no weight.

Counting at scale: documents are gathered into blocks of a bounded number of tokens, held
out or not. A block sends its different unigrams and bigrams with their counts, cut into
hash buckets, once through a shuffle; each bucket is summed by itself and sends every block
the totals of just the n-grams that it asked for, in the order in which it asked. A frequent
word is thus one entry a block, and nothing is looked up row by row. What is gathered grows
with the corpus; the driver gets the number of tokens and words, and a histogram of the
deleted estimates on a fixed grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import ship, texts, written
from govlens.llm.words import hashed_words, mix, word_hash

BLOCK_TOKENS = 1_000_000
BUCKET_BYTES = 8_000_000  # of text, for each hash bucket of n-grams
RESIDUE = 40  # bits of a bigram's hash below its bucket's: collisions of 1 in 10^7 at any size
GRID = 4  # steps of a probability's binary logarithm in the histogram for the weights
FLOOR = -160 * GRID
ROUNDS = 50

# Words have no space in them, so these are no word's hashes.
END, START = (np.uint64(word_hash(x)) for x in (b"a text's end", b"a text's start"))


@dataclass
class Pieces:
    """Texts (or parts of one) of a block under construction: hashes with the context of the
    first token in front."""
    held: bool  # out of training
    weigh: bool  # in training, and its tokens teach the weights
    rows: list[tuple[int, int | None, int]] = field(default_factory=list)  # text number, doc_id, tokens
    hashes: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, number: int, doc_id: int | None, hashes: np.ndarray) -> None:
        self.rows.append((number, doc_id, len(hashes) - 1))
        self.hashes.append(hashes)
        self.size += len(hashes)

    def packed(self) -> dict:
        """``words``: the block's different hashes, frequent ones first; ``tokens``: their ranks in
        order, compressed; and per text its number, doc_id and tokens."""
        words, inverse, count = np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        numbers, ids, sizes = zip(*self.rows, strict=True)
        return {"held": self.held, "weigh": self.weigh, "words": words[order].tobytes(),
                "tokens": zstandard.compress(rank[inverse].tobytes(), 3),
                "numbers": list(numbers), "ids": list(ids), "sizes": list(sizes)}


BLOCKS = ("block long, held boolean, weigh boolean, words binary, tokens binary, numbers array<long>, ids array<long>, sizes array<long>")
_BLOCKS = pa.schema([("block", pa.int64()), ("held", pa.bool_()), ("weigh", pa.bool_()), ("words", pa.binary()), ("tokens", pa.binary()),
                     ("numbers", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def gathered(rows: DataFrame, block_tokens: int) -> DataFrame:
    """The blocks of (doc_id, text, part), part 0: held out, 1: teaches the weights. A text longer than a block goes on in the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block = TaskContext.get().partitionId() << 32
        open_blocks = {part: Pieces(part == 0, part == 1) for part in (0, 1, 2)}

        def flush(part: int) -> Iterator[pa.RecordBatch]:
            nonlocal block
            if open_blocks[part].rows:
                row = {"block": block, **open_blocks[part].packed()}
                block += 1
                open_blocks[part] = Pieces(part == 0, part == 1)
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        for batch in batches:
            for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(),
                                          strict=True):
                tokens = np.concatenate([[START], hashed_words(text.as_py()), [END]]).astype(np.uint64)
                at = 0
                while at < len(tokens) - 1:
                    pieces = open_blocks[part]
                    some = tokens[at:at + 1 + max(1, block_tokens - pieces.size)]
                    pieces.add(number, doc_id, some)
                    at += len(some) - 1
                    if pieces.size >= block_tokens:
                        yield from flush(part)
                number += 1
        for part in open_blocks:
            yield from flush(part)

    return rows.select("doc_id", "text", "part").mapInArrow(run, BLOCKS)


class Block:
    """A block read back: ``tokens`` are ranks in ``words``; ``scored`` marks tokens that are
    not just the context of a text's first."""

    def __init__(self, row: dict, bits: int):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint32)
        self.sizes = np.array(row["sizes"], np.int64)
        self.firsts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.scored = np.ones(len(self.tokens), bool)
        self.scored[self.firsts] = False
        self.sorted = np.argsort(self.words)
        at = np.flatnonzero(self.scored)
        self.after, self.before = self.tokens[at], self.tokens[at - 1]
        h = self.words
        with np.errstate(over="ignore"):
            both = mix(h[self.before] * np.uint64(0x9E3779B97F4A7C15) + mix(h[self.after]))
        self.pairs, self.pair = np.unique(both >> np.uint64(64 - bits - RESIDUE), return_inverse=True)

    def word_counts(self) -> np.ndarray:
        """Of each word, in sorted order: as a token, and the start mark as a context."""
        n = np.bincount(self.after, minlength=len(self.words))
        at = np.flatnonzero(self.words == START)
        n[at] = (self.tokens[self.firsts] == at[0]).sum() if len(at) else 0
        return n[self.sorted]

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair, minlength=len(self.pairs))


def _cut(keys: np.ndarray, shift: int, buckets: int) -> np.ndarray:
    """Where each bucket of sorted ``keys`` begins, and the end."""
    return np.searchsorted(keys >> np.uint64(shift), np.arange(buckets + 1, dtype=np.uint64))


_REQUEST = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("weigh", pa.bool_()),
                      ("keys", pa.binary()), ("counts", pa.binary())])
REQUEST = "bucket long, block long, kind int, weigh boolean, keys binary, counts binary"
UNIGRAMS, BIGRAMS = 0, 1


def _small(n: np.ndarray) -> bytes:
    return zstandard.compress(n.astype(np.uint32).tobytes(), 1)


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.uint32).astype(np.int64)


def _keys(kind: int, keys: np.ndarray) -> bytes:
    """Bigram keys of one bucket as differences of 32 bits where they fit (else as they are,
    which the length tells)."""
    if kind == UNIGRAMS:
        return keys.tobytes()
    gaps = np.diff(keys & np.uint64((1 << RESIDUE) - 1), prepend=np.uint64(0))
    return (gaps.astype(np.uint32) if (gaps >> np.uint64(32)).max(initial=0) == 0 else gaps).tobytes()


def _unkeyed(kind: int, blob: bytes, n: int) -> np.ndarray:
    if kind == UNIGRAMS:
        return np.frombuffer(blob, np.uint64)
    return np.cumsum(np.frombuffer(blob, np.uint32 if len(blob) == 4 * n else np.uint64).astype(np.uint64))


def requested(blocks: DataFrame, bits: int) -> DataFrame:
    """Per block, kind and hash bucket: the different n-grams and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row, bits)
                out = []
                for kind, keys, n, shift in ((UNIGRAMS, b.words[b.sorted], b.word_counts(), 64 - bits),
                                             (BIGRAMS, b.pairs, b.pair_counts(), RESIDUE)):
                    ends = _cut(keys, shift, 1 << bits)
                    for bucket in np.flatnonzero(np.diff(ends)):
                        lo, hi = ends[bucket], ends[bucket + 1]
                        counts = np.zeros(hi - lo) if row["held"] else n[lo:hi]
                        out.append({"bucket": int(bucket) * 2 + kind, "block": row["block"], "kind": kind,
                                    "weigh": row["weigh"], "keys": _keys(kind, keys[lo:hi]), "counts": _small(counts)})
                yield pa.RecordBatch.from_pylist(out, schema=_REQUEST)

    return blocks.select("block", "held", "weigh", "words", "tokens", "sizes").mapInArrow(run, REQUEST)


_TOTALS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("weigh", pa.bool_()), ("totals", pa.binary()),
                     ("n", pa.int64()), ("v", pa.int64())])
TOTALS = "block long, bucket long, weigh boolean, totals binary, n long, v long"


def answered(requests: DataFrame) -> DataFrame:
    """Per request the corpus totals of its n-grams, in its order; and per bucket of unigrams a row
    without a block: training tokens n and different words v."""
    def answer(rows: list[dict]) -> pa.RecordBatch:
        kind, out = rows[0]["kind"], []
        counts = [_counts(r["counts"]) for r in rows]
        keys = [_unkeyed(kind, r["keys"], len(c)) for r, c in zip(rows, counts, strict=True)]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        at = 0
        for r, c in zip(rows, counts, strict=True):
            out.append({"block": r["block"], "bucket": r["bucket"], "weigh": r["weigh"],
                        "totals": _small(total[inverse[at:at + len(c)]])})
            at += len(c)
        if kind == UNIGRAMS:
            token = distinct != START
            out.append({"n": int(total[token].sum()), "v": int((total[token] > 0).sum())})
        return pa.RecordBatch.from_pylist(out, schema=_TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["bucket"] != r["bucket"]:
                    yield answer(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield answer(rows)

    return (requests.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, TOTALS))


def _with_totals(blocks: DataFrame, totals: DataFrame, function, schema: str) -> DataFrame:
    """``function(block's row, [(bucket, totals)])`` for each block: a block's row and its totals
    are brought together, both of bounded size."""
    row = F.struct("block", "held", "words", "tokens", "numbers", "ids", "sizes")
    both = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), row.alias("row"), F.lit(None).cast("binary").alias("totals"))
    both = both.unionByName(totals.filter(F.col("block").isNotNull()).select(
        "block", "bucket", F.lit(None).cast(both.schema["row"].dataType).alias("row"), "totals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, found = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["row"] is not None:
                    if row is not None:
                        yield function(row, found)
                    row, found = r["row"], []
                else:
                    found.append((r["bucket"], r["totals"]))
        if row is not None:
            yield function(row, found)

    return both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)


def _estimates(b: Block, found: list[tuple[int, bytes]], n: int, v: int, deleted: int = 0):
    """Per scored token: its corpus count, context bucket, and the three estimates; with ``deleted``
    1 the token itself, one of the corpus, is taken out of the counts."""
    per = {k: [_counts(t) for bucket, t in found if bucket % 2 == k] for k in (UNIGRAMS, BIGRAMS)}
    words = np.zeros(len(b.words), np.int64)
    words[b.sorted] = np.concatenate(per[UNIGRAMS])
    pairs = np.concatenate(per[BIGRAMS])[b.pair]
    context, count, pairs, n = words[b.before] - deleted, words[b.after] - deleted, pairs - deleted, n - deleted
    level = np.ceil(np.log2(context + 1)).astype(np.int64)  # 0: the context is not known
    return count, level, pairs / np.maximum(context, 1), count / max(n, 1), 1 / (v + 1)


def _grid(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.round(GRID * np.log2(p)), FLOOR).astype(np.int64)


def deleted_histogram(blocks: DataFrame, totals: DataFrame, bits: int, n: int, v: int) -> DataFrame:
    """level, p2, p1 (grid steps) and tokens, of the blocks that teach the weights: at most some 40
    levels of (640 steps)^2, however many documents there are."""
    def function(row: dict, found: list) -> pa.RecordBatch:
        _, level, p2, p1, _ = _estimates(Block(row, bits), found, n, v, deleted=1)
        cell, count = np.unique(np.stack([level, _grid(p2), _grid(p1)]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cell), pa.array(count)], ["level", "p2", "p1", "n"])

    cells = _with_totals(blocks.filter("weigh"), totals.filter("weigh"), function, "level long, p2 long, p1 long, n long")
    return cells.groupBy("level", "p2", "p1").agg(F.sum("n").alias("n"))


def learned(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = ROUNDS) -> dict[int, tuple]:
    """Weights (bigram, unigram, uniform) of each level by expectation-maximisation; level -1
    has those of all levels together, for levels that no token that teaches them has."""
    def em(c: np.ndarray) -> tuple:
        p = np.stack([np.where(c[:, i] <= FLOOR, 0.0, 2.0 ** (c[:, i] / GRID)) for i in (1, 2)]
                     + [np.full(len(c), uniform)], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = p * w
            part = part / part.sum(axis=1, keepdims=True) * c[:, 3:]
            # a little of each, so that no weight becomes 0 and no token impossible
            w = (part.sum(axis=0) + 1e-3) / (c[:, 3].sum() + 3e-3)
        return tuple(float(x) for x in w)

    c = np.array(sorted(cells), float).reshape(-1, 4)
    out = {-1: em(c)} if len(c) else {-1: (1 / 3, 1 / 3, 1 / 3)}
    for level in np.unique(c[:, 0]):
        out[int(level)] = em(c[c[:, 0] == level])
    return out


SCORES = ("number long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def scored(blocks: DataFrame, totals: DataFrame, bits: int, n: int, v: int, weights: dict[int, tuple]) -> DataFrame:
    """Sums per text and block."""
    top = max(weights)
    table = np.array([weights.get(level, weights[-1]) for level in range(64)])
    table[top + 1:] = weights.get(top, weights[-1]) if top >= 0 else weights[-1]
    names = [x.split()[0] for x in SCORES.split(", ")]

    def function(row: dict, found: list) -> pa.RecordBatch:
        b = Block(row, bits)
        count, level, p2, p1, p0 = _estimates(b, found, n, v)
        w = table[level]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        starts = np.cumsum(b.sizes) - b.sizes
        sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, model)]
        return pa.RecordBatch.from_arrays(
            [pa.array(row["numbers"], pa.int64()), pa.array(row["ids"], pa.int64()),
             pa.array([row["held"]] * len(starts), pa.bool_()), pa.array(b.sizes), *map(pa.array, sums)], names)

    return _with_totals(blocks, totals, function, SCORES)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 10,
                    block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    and score (both log10 of the whole text's probability).

    Held out are documents with crc32(doc_id as text) mod ``held_out_of`` = 0; those without an
    id are not. All others are counted, and those with remainder 1 teach the weights. Tokens are words (A-Z lower-cased, cut at space and \\x09-\\x0D) and an end; null
    and empty texts have the end alone. Repeated rows are scored, and counted, each. Other
    columns are ignored; an empty table gives an empty result. Without a document of
    remainder 1 the three estimates weigh the same.
    """
    spark = docs.sparkSession
    ship(spark)
    part = F.least(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out_of)), F.lit(2))
    rows = texts(docs, id_col, text_col).withColumn("part", F.coalesce(part, F.lit(2)).cast("int"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max(2, (size // BUCKET_BYTES).bit_length()), 64 - RESIDUE)
    blocks = written(gathered(rows, block_tokens), "blocks")
    totals = written(answered(requested(blocks, bits)), "totals")
    n, v = totals.filter("block is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    cells = [tuple(r) for r in deleted_histogram(blocks, totals, bits, n, v).collect()]
    weights = learned(cells, 1 / (v + 1))
    return (scored(blocks, totals, bits, n, v, weights).groupBy("number").agg(
        F.min("doc_id").alias("doc_id"), F.every("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                "base_score", "score"))
