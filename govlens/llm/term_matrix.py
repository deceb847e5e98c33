"""Sparse document-term matrix of a corpus, in CSR shards.

1. Blocks: each task cuts its documents into blocks of about ``BLOCK_BYTES`` of text (a longer
   document is a block of its own), splits words and keeps per block its list of different words
   and, per document, the places of its words in that list with their counts.
2. Dictionary: the words of all blocks' lists meet by word and are numbered (``dictionary``).
3. Shards: each block gets the numbers of its words back, which become the column indices;
   every row's columns are sorted.

Only different words of blocks are shuffled for the dictionary; a block moves once, compressed,
to meet its numbers. No document is ever split, so a row lies in one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from govlens.llm.common import ship, written
from govlens.llm.dictionary import by_block, numbered_words

BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20  # of a block, split into words at a time

_DOC = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_upper", pa.int64()), ("symbol", pa.bool_()),
        ("digest", pa.binary())]
_BLOCK = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.string())), ("indptr", pa.binary()),
                    ("indices", pa.binary()), ("data", pa.binary()),
                    *((n, pa.list_(t)) for n, t in _DOC), ("part", pa.list_(pa.string()))])
BLOCK = ("block long, words array<string>, indptr binary, indices binary, data binary, doc_id array<long>, "
         "n_chars array<long>, n_upper array<long>, symbol array<boolean>, digest array<binary>, part array<string>")
SHARD = ("shard long, doc_id array<long>, part array<string>, n_chars array<long>, n_upper array<long>, "
         "symbol array<boolean>, digest array<binary>, indptr binary, indices binary, data binary")
TOTALS = ("doc_id long, part string, n_chars long, n_upper long, symbol boolean, digest binary, "
          "n_words long, n_distinct long")
_TOTALS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("n_chars", pa.int64()), ("n_upper", pa.int64()),
                     ("symbol", pa.bool_()), ("digest", pa.binary()), ("n_words", pa.int64()), ("n_distinct", pa.int64())])
_SHARD = pa.schema([("shard", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("part", pa.list_(pa.string())),
                    ("n_chars", pa.list_(pa.int64())), ("n_upper", pa.list_(pa.int64())), ("symbol", pa.list_(pa.bool_())),
                    ("digest", pa.list_(pa.binary())), ("indptr", pa.binary()), ("indices", pa.binary()), ("data", pa.binary())])


@dataclass
class Csr:
    """Rows of a shard: the columns of row i are ``indices[indptr[i]:indptr[i + 1]]``, ascending;
    ``data`` has how often each occurs in the row."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray

    def row_sums(self) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(self.data, dtype=np.int64)])
        return ends[self.indptr[1:]] - ends[self.indptr[:-1]]

    def row_nonzeros(self) -> np.ndarray:
        return np.diff(self.indptr)

    def with_columns(self, numbers: np.ndarray) -> Csr:
        """The same rows with column ``numbers[j]`` for j, sorted within each row."""
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        columns = numbers[self.indices]
        order = np.lexsort((columns, rows))
        return Csr(self.indptr, columns[order], self.data[order])


def _counted(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> Csr:
    """From one (row, column) per occurrence."""
    keys, counts = np.unique(rows * max(n_columns, 1) + columns, return_counts=True)
    of = keys // max(n_columns, 1)
    return Csr(np.searchsorted(of, np.arange(n_rows + 1)), (keys % max(n_columns, 1)).astype(np.int32),
               counts.astype(np.int32))


def _sums(flags: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Set flags per text; a text of no bytes has none."""
    out, some = np.zeros(len(sizes), np.int64), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(flags, starts[some], dtype=np.int64)
    return out


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpacked(packed: pa.Scalar, kind: type) -> np.ndarray:
    """An array of a block or shard."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_buffer()), kind)


def _slices(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes, at least one text each; ``ends``: where each text ends."""
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, end
        at = end


def _slice(texts: pa.Array, symbols: np.ndarray) -> tuple[pa.Array, Csr, tuple]:
    """Different words, rows over their places and (n_chars, n_upper, symbol) of texts (large_string, no nulls)."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    held = raw.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0]:ends[-1]] if held is not None else np.zeros(0, np.uint8)
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # what the split leaves at the ends of a text
        of, places = of[places != empty], places[places != empty]
        places = places - (places > empty)
    listed = coded.dictionary.filter(pc.not_equal(coded.dictionary, ""))
    # texts end on whole characters, so bytes that continue one are counted with it
    return listed, _counted(of, places, len(texts), len(listed)), (
        sizes - _sums((data & 0xC0) == 0x80, starts, sizes), _sums((data - np.uint8(65)) < 26, starts, sizes),
        _sums(symbols[data], starts, sizes) > 0)


def _block(number: int, ids: pa.Array, parts: pa.Array, texts: pa.Array, symbols: np.ndarray) -> dict:
    """A row of BLOCK for texts (large_string, no nulls)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    listed, rows, counts = zip(*(_slice(texts[a:z], symbols) for a, z in _slices(ends, SLICE_BYTES)), strict=True)
    merged = pa.concat_arrays(listed).dictionary_encode()
    of = np.split(merged.indices.to_numpy(zero_copy_only=False), np.cumsum([len(x) for x in listed])[:-1])
    starts = np.cumsum([0, *(len(r.indices) for r in rows)])
    chars, upper, symbol = (np.concatenate(x) for x in zip(*counts, strict=True))
    return {
        "block": number, "words": merged.dictionary.cast(pa.string()), "doc_id": ids, "part": parts,
        "indptr": _packed(np.concatenate([[0], *(r.indptr[1:] + s for r, s in zip(rows, starts, strict=False))]).astype(np.int64)),
        "indices": _packed(np.concatenate([o[r.indices] for r, o in zip(rows, of, strict=True)]).astype(np.int32)),
        "data": _packed(np.concatenate([r.data for r in rows])),
        "n_chars": pa.array(chars), "n_upper": pa.array(upper), "symbol": pa.array(symbol),
        "digest": pa.array([hashlib.blake2b(t.as_buffer(), digest_size=16).digest() for t in texts.cast(pa.large_binary())], pa.binary()),
    }


def word_blocks(docs: DataFrame, symbols: str = "", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``docs`` (doc_id long, part string, text string without nulls), written."""
    marks = np.zeros(256, bool)
    marks[list(symbols.encode("ascii"))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch["text"].cast(pa.large_string())
            for at, end in _slices(np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), block_bytes):
                row = _block(number, batch["doc_id"][at:end], batch["part"][at:end], texts[at:end], marks)
                yield pa.RecordBatch.from_arrays([_one(row[f.name], f.type) for f in _BLOCK], schema=_BLOCK)
                number += 1

    ship(docs.sparkSession)
    return written(docs.select("doc_id", "part", "text").mapInArrow(run, BLOCK), "word-blocks")


def _one(value, kind: pa.DataType) -> pa.Array:
    """An array of one row."""
    if isinstance(value, pa.Array):
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)
    return pa.array([value], kind)


def _shards(blocks: DataFrame, numbers: DataFrame, build, schema: str) -> DataFrame:
    # outer: a block of empty texts has no words
    both = blocks.drop("words").join(by_block(numbers).hint("merge"), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                local = Csr(*(unpacked(row[n], t) for n, t in (("indptr", np.int64), ("indices", np.int32), ("data", np.int32))))
                places, given = (row[n].values for n in ("places", "numbers"))
                columns = np.zeros(0 if places is None else len(places), np.int64)
                if places is not None:
                    columns[places.to_numpy(zero_copy_only=False)] = given.to_numpy(zero_copy_only=False)
                yield build(row, local.with_columns(columns))

    ship(blocks.sparkSession)
    return both.mapInArrow(run, schema)


def csr_shards(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """The matrix: a row per shard with its documents' attributes (arrays) and the CSR arrays
    ``indptr`` (int64), ``indices`` (word numbers, int64) and ``data`` (int32), packed (:func:`unpacked`)."""
    def build(row: dict, rows: Csr) -> pa.RecordBatch:
        values = {"shard": row["block"].as_py(), "indptr": _packed(rows.indptr), "indices": _packed(rows.indices),
                  "data": _packed(rows.data)}
        return pa.RecordBatch.from_arrays([_one(values[f.name] if f.name in values else row[f.name].values, f.type)
                                           for f in _SHARD], schema=_SHARD)

    return _shards(blocks, numbers, build, SHARD)


def row_totals(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """A row per document: its attributes, ``n_words`` (its row's sum) and ``n_distinct`` (its row's
    nonzero entries), from the shards of the matrix as they are built."""
    def build(row: dict, rows: Csr) -> pa.RecordBatch:
        totals = {"n_words": pa.array(rows.row_sums(), pa.int64()), "n_distinct": pa.array(rows.row_nonzeros(), pa.int64())}
        return pa.RecordBatch.from_arrays([totals[f.name] if f.name in totals else row[f.name].values.cast(f.type)
                                           for f in _TOTALS], schema=_TOTALS)

    return _shards(blocks, numbers, build, TOTALS)
