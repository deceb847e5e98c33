"""Benchmark decontamination by the q-gram lemma.

A text that holds a copy of an item of m characters with at most k edits shares at
least m - q + 1 - q*k of the item's q-grams with it, and their diagonals (place in the
text less place in the item) differ by at most k. Shared q-grams are counted in
diagonal bands of width 2(k + 1) that overlap by half, so one band holds them all; the
bands that reach the bound are verified by banded alignment, which gives span and edits.

The benchmark is the stated query set: it is taken in blocks of bounded size, each
broadcast as an index and run against all documents. Documents are never shuffled.
Texts are handled in segments of bounded size that overlap by the longest region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import ship

Q = 8
EDITS_PERCENT = 8
BLOCK_CHARS = 4_000_000
SEGMENT_CHARS = 2_000_000
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

LEAK = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))
_ARROW_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("edits", pa.int32())]))


def normal(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place (one place less for each of q - 1)."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            h *= _MIX
            h += codes[i:i + n]
        h ^= h >> np.uint64(29)
        h *= _MIX
    return h


def budget(length: int, q: int, percent: int) -> int:
    """Edits allowed in an item of this length: ``percent`` of it, as far as the bound of the
    lemma stays at one shared q-gram or more (shorter than q: none)."""
    return max(0, min(length * percent // 100, (length - q) // q))


class Index:
    """q-grams of one block of items: sorted hashes with the (item, place) of each."""

    def __init__(self, items: list[tuple[int, str]], q: int, percent: int):
        self.q = q
        self.items = [(i, n) for i, t in items if (n := normal(t))]
        self.codes = [_codes(t) for _, t in self.items]
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.array([budget(m, q, percent) for m in self.m], np.int64)
        self.bound = self.m - q + 1 - q * self.k
        self.short = [n for n, m in enumerate(self.m) if m < q]  # these are searched exactly
        grams = [gram_hashes(c, q) for c in self.codes]
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.table = np.zeros(1 << _BITS, np.bool_)
        self.table[self.hash >> np.uint64(64 - _BITS)] = True
        self.reach = int((self.m + 4 * (self.k + 1)).max()) if len(self.m) else 0
        self.least = int(self.bound.min()) if len(self.m) else 0

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text place, item, item place) of every q-gram that text and items share."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _BITS)])
        if len(at) >= self.least and len(self.hash):
            at = self._dense(at)
        where = np.searchsorted(self.hash, h[at])
        where[where == len(self.hash)] = 0
        ok = self.hash[where] == h[at] if len(self.hash) else np.zeros(len(at), np.bool_)
        at, where = at[ok], where[ok]
        n = self.count[where]
        entry = np.repeat(self.first[where] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(n) else at
        return np.repeat(at, n), self.item[entry], self.place[entry]

    def _dense(self, at: np.ndarray) -> np.ndarray:
        """Places that lie in some window of the longest region with the least bound of hits:
        no other place can belong to a copy."""
        ahead = np.searchsorted(at, at + self.reach) - np.arange(len(at))
        starts = np.flatnonzero(ahead >= self.least)
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + ahead[starts], -1)
        return at[np.cumsum(cover[:-1]) > 0]

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, first diagonals of its bands that reach the bound)."""
        at, item, place = self.shared(codes)
        if not len(at):
            return
        width = self.k[item] + 1
        band = (at - place + self.reach) // width
        key = np.concatenate([item.astype(np.int64) << 40 | band, item.astype(np.int64) << 40 | (band - 1)])
        keys, counts = np.unique(key, return_counts=True)
        items = keys >> 40
        ok = counts >= self.bound[items]
        for n in np.unique(items[ok]):
            bands = keys[ok & (items == n)] & ((1 << 40) - 1)
            yield int(n), bands * (self.k[n] + 1) - self.reach


def align(pattern: np.ndarray, text: np.ndarray, starts: np.ndarray, k: int, lo: np.ndarray,
          hi: np.ndarray) -> list[tuple[int, int, int]]:
    """Banded alignment of ``pattern`` around the diagonals [start, start + 2(k+1)) of each
    start, within its own text[lo:hi] and free at both ends of that: per start the best
    (edits, first, end)."""
    m, pad = len(pattern), k
    lo, hi = lo[:, None], hi[:, None]
    width = 2 * (k + 1) + 2 * pad
    column = np.arange(width)
    base = (starts - pad)[:, None] + column  # place in the text of diagonal o at row 0
    big = np.int32(m + k + 1)
    cost = np.where((base >= lo) & (base <= hi), 0, big).astype(np.int32)
    first = base.astype(np.int64)
    padded = np.append(text.astype(np.int64), -1)
    outside = len(text)
    for i in range(m):
        j = base + i
        inside = (j >= lo) & (j < hi)
        differs = padded[np.where(inside, j, outside)] != int(pattern[i])
        over = np.where(inside, cost + differs, big)
        skip = np.append(cost[:, 1:], np.full((len(starts), 1), big, np.int32), axis=1) + 1  # pattern's only
        came = np.append(first[:, 1:], first[:, -1:], axis=1)
        take = skip < over
        best, origin = np.where(take, skip, over), np.where(take, came, first)
        best = np.where((j + 1 >= lo) & (j + 1 <= hi), best, big)
        level = best - column
        low = np.minimum.accumulate(level, axis=1)  # text's only: along the row
        source = np.maximum.accumulate(np.where(level == low, column, 0), axis=1)
        cost = (low + column).astype(np.int32)
        first = np.take_along_axis(origin, source, axis=1)
    end = np.argmin(cost, axis=1)
    rows = np.arange(len(starts))
    return [(int(c), int(f), int(e)) for c, f, e in zip(
        cost[rows, end], first[rows, end], base[rows, end] + m, strict=True)]


def find_copies(index: Index, text: str, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(part, item number, start, end, edits) in the normalised ``text``, whose parts are
    text[first:end]. No region leaves its part; of one item's overlapping regions the best."""
    found = []
    for n in index.short:
        item, at = index.items[n][1], text.find(index.items[n][1])
        while at >= 0:
            part = int(np.searchsorted(first, at, "right")) - 1
            inside = at + len(item) <= end[part]
            if inside:
                found.append((part, n, at, at + len(item), 0))
            at = text.find(item, at + (len(item) if inside else 1))
    codes = _codes(text)
    for n, starts in index.candidates(codes):
        m, k, item = int(index.m[n]), int(index.k[n]), index.items[n][1]
        regions: list[tuple[int, int, int, int]] = []
        rest = []
        for s in starts:
            lo, hi = int(s) - k, int(s) + 2 * (k + 1) + m + k
            near = np.arange(np.searchsorted(end, lo, "right"), np.searchsorted(first, hi))
            room = np.minimum(end[near], hi) - np.maximum(first[near], lo)
            for part in near[room >= m - k]:  # the others are too short for a copy
                at = text.find(item, max(lo, int(first[part])), min(hi, int(end[part])))
                if at >= 0:
                    regions.append((0, at, at + m, int(part)))
                else:
                    rest.append((int(s), int(part)))
        for some in range(0, len(rest), 256):
            s, part = np.array(rest[some:some + 256]).T
            regions += [(*r, int(p)) for r, p in zip(
                align(index.codes[n], codes, s, k, first[part], end[part]), part, strict=True) if r[0] <= k]
        last: dict[int, list[tuple[int, int, int]]] = {}
        for e, a, b, part in sorted(set(regions), key=lambda r: (r[0], r[1])):
            if all(b <= o[1] or a >= o[2] for o in last.setdefault(part, [])):
                last[part].append((e, a, b))
        found += [(part, n, a, b, e) for part, some in last.items() for e, a, b in some]
    return found


def find_leaks(index: Index, texts: list[str | None]) -> list[list[dict]]:
    """Copies of the index's items in each text. Many short texts share one pass; a long
    text is taken in segments that overlap by the longest region."""
    out: list[dict[tuple, dict]] = [{} for _ in texts]
    parts: list[tuple[int, int, int, str]] = []  # (row, offset in its text, place in the pass, text)
    size = 0

    def flush():
        nonlocal parts, size
        if parts:
            first = np.array([p[2] for p in parts])
            end = first + np.array([len(p[3]) for p in parts])
            for at, n, a, b, edits in find_copies(index, "\0".join(p[3] for p in parts), first, end):
                row, offset, place, _ = parts[at]
                a, b = a - place + offset, b - place + offset
                out[row][n, a, b] = {"item_id": index.items[n][0], "start": a, "end": b, "edits": edits}
        parts, size = [], 0

    for row, text in enumerate(texts):
        whole = normal(text or "")
        offset = 0
        while offset < len(whole):
            part = whole[offset:offset + SEGMENT_CHARS]
            if parts and size + len(part) > SEGMENT_CHARS:
                flush()
            parts.append((row, offset, size, part))
            size += len(part) + 1
            if offset + len(part) >= len(whole):
                break
            offset += SEGMENT_CHARS - index.reach
    flush()
    return [[d[key] for key in sorted(d, key=lambda x: (x[1], x[2], x[0]))] for d in out]


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", q: int = Q, percent: int = EDITS_PERCENT,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with column ``leaks``: per copy of an item its item_id, start and end (in the
    normalised text) and edits.

    Null or empty texts have no leaks, null or empty items are never found, repeated items
    are each reported. All columns of ``docs`` stay; one named ``leaks`` is replaced. An
    empty table of documents gives an empty result, an empty benchmark no leaks. An item's
    size is bounded by ``SEGMENT_CHARS`` / 4 characters; a longer one raises ValueError.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"),
                             F.col(item_text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    size, longest = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.max(F.length("text"))).first()
    if (longest or 0) > SEGMENT_CHARS // 4:
        raise ValueError(f"an item of {longest} characters; at most {SEGMENT_CHARS // 4}")
    blocks = max(1, -(-size // block_chars))
    columns = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast(LEAK).alias("leaks"))
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r.item_id, r.text) for r in some.collect()), key=lambda x: (x[0] is None, x))
        out = _one_block(out, Index(rows, q, percent), text_col)
    return out


def _one_block(docs: DataFrame, index: Index, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            before = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(at)
            leaks = find_leaks(own, [t.as_py() for t in texts.cast(pa.string())])
            column = pa.array([(b or []) + new for b, new in zip(before, leaks, strict=True)], _ARROW_LEAK)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a copy of an item, with the columns of ``docs``."""
    return (with_leaks(docs, benchmark, **options).filter(F.size("leaks") == 0)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
