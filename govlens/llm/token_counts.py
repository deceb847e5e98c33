"""Token counts of whole texts by a byte-level BPE tokenizer.

Two tiers, both on the map side, so no pre-token is ever shuffled:

1. a hash table pre-token -> number of tokens of the corpus's frequent pre-tokens
   (at most ``table_size`` entries of at most ``MAX_WORD`` characters, hence of a
   proven size), broadcast to all tasks;
2. a miss is encoded once per Python worker and kept in that worker's cache, which
   starts anew when it holds ``cache_size`` entries.

The table only saves work: counts are the library's, whatever it holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import ship, texts, written

TABLE_SIZE = 8_192
CACHE_SIZE = 1_000_000
MAX_WORD = 64
LIMIT = 512

# The tokenizer's pre-token pattern (white space as Unicode has it,
# as in the library) and the special string that its default takes as one token.
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SPECIAL = "<|endoftext|>"

# Code points on whose class this pattern and the library's own Unicode tables agree
# (tests/llm compares them one by one); a text with any other goes to the library whole.
AGREED = (r"[\x00-\u0557\u0559-\u058a\u0600-\u06ff\u0900-\u0950\u1e00-\u1fff\u2000-\u206f\u20a0-\u20bf"
          r"\u2140-\u218b\u2190-\u23ff\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff00-\uffef\ufffd"
          r"\U0001f300-\U0001f64f]*")

_WORKER: dict = {}  # of this Python worker: tokenizers and caches by path


def _tokenizer(path: str):
    if path not in _WORKER:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _WORKER[path] = t
    return _WORKER[path]


def encoded_length(path: str, text: str) -> int:
    return len(_tokenizer(path).encode(text, add_special_tokens=False).ids)


class Lengths(dict):
    """Pre-token -> number of tokens; encodes what it lacks and keeps it, within a bound."""

    def __init__(self, path: str, frequent: dict[str, int], cache_size: int):
        super().__init__(frequent)
        self.path, self.frequent, self.bound = path, frequent, len(frequent) + cache_size

    def __missing__(self, piece: str) -> int:
        n = encoded_length(self.path, piece)
        if len(self) >= self.bound:
            self.clear()
            self.update(self.frequent)
        self[piece] = n
        return n


def _text_counter(lengths: Lengths):
    pieces, agreed, path = regex.compile(PRE_TOKEN).findall, regex.compile(AGREED).fullmatch, lengths.path

    def count(text: str) -> int:
        if text.isascii() or agreed(text):
            parts = text.split(SPECIAL) if SPECIAL in text else (text,)
            return len(parts) - 1 + sum(sum(map(lengths.__getitem__, pieces(p))) for p in parts)
        return encoded_length(path, text)

    return count


def frequent_words(docs: DataFrame, size: int = TABLE_SIZE) -> DataFrame:
    """The ``size`` most frequent words of column ``text`` (word, n), over all rows.

    Each task keeps a bounded table of counters and emits at most ``size`` words, so
    what is shuffled grows with the number of tasks, not with the words of the texts. Only
    words of a certain share of all counts are ranked: there can be no more than
    ``16 * size`` of them, however many partitions rank theirs.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.split())
                if len(counts) > 16 * size:
                    counts = Counter(dict(counts.most_common(size)))
        top = [(w, n) for w, n in counts.most_common(size) if len(w) <= MAX_WORD]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    counts = written(docs.select("text").mapInArrow(summarise, "word string, n long")
                     .groupBy("word").agg(F.sum("n").alias("n")), "frequent-words")
    total = counts.agg(F.sum("n")).scalar()
    return counts.filter(F.col("n") * (16 * size) >= total).orderBy(F.desc("n"), "word").limit(size)


def length_table(words: list[str], path: str) -> dict[str, int]:
    """Lengths of the pre-tokens of ``words``, each as it stands after a space and first in a line."""
    find = regex.compile(PRE_TOKEN).findall
    pieces = {p for w in words if SPECIAL not in w for p in (*find(" " + w), *find(w))}
    return {p: encoded_length(path, p) for p in sorted(pieces)}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null text: empty, 0 tokens. Null ids and repeated rows stay as they are. An empty
    table gives an empty result. Columns other than the two named are ignored. Texts
    of any length are counted whole.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = texts(docs, id_col, text_col)
    top = [r.word for r in frequent_words(rows, table_size).collect()]
    table = spark.sparkContext.broadcast(length_table(top, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ("lengths", path) not in _WORKER:
            _WORKER["lengths", path] = Lengths(path, table.value, cache_size)
        of = _text_counter(_WORKER["lengths", path])
        for batch in batches:
            text = batch.column(1)
            n = [of(t.as_py()) for t in text]
            size = pc.binary_length(text.cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
