"""Phrase collocations: word sequences that stand together more often than their parts do.

1. Blocks: each task splits its documents into pieces and words and keeps, per block of one
   language, the list of different words and the words' places in it.
2. Dictionary: words of ``MIN_COUNT`` occurrences or more are numbered (``dictionary``); no
   phrase with a rarer word can be a candidate or a part of one, so such a word ends a sequence
   as a piece's end does. Blocks get the numbers of their words back.
3. Counting: from every place of a block the sequence of up to four words goes into the task's
   HAT-trie (``hat_trie``), where a shorter phrase's count is the sum of its subtree. Subtrees
   that leave the trie are sorted runs; their entries are dealt to prefix partitions, where runs
   are merged and phrases of ``MIN_COUNT`` or more kept.
4. Scores, nesting and ranks are joins of the kept phrases, at most one per ``MIN_COUNT`` words.

Entries are dealt by their first three words, and the sums of pairs by the pair, so that no single
word or pair, however frequent, makes a partition larger than its different continuations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import ship, written
from govlens.llm.dictionary import numbered, numbers_of_blocks
from govlens.llm.hat_trie import LEVELS, NONE, ROOM, HatTrie, counted, id_type, in_order

MIN_COUNT, NESTED_PERCENT, TOP = 30, 80, 2000
BLOCK_BYTES = 8 << 20
PART_WORDS = 2_000_000  # words for each prefix partition
GATHERED = 1 << 19  # entries of runs that leave a task together, or that a partition holds unmerged

# Characters that end a piece; a tab parts words as a space does.
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")

BLOCK = "block long, lang string, words array<string>, counts array<long>, tokens binary"
_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())),
                    ("counts", pa.list_(pa.int64())), ("tokens", pa.binary())])
_RUN = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_PHRASE = pa.schema([("phrase", pa.list_(pa.int64())), ("f", pa.int64())])


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The different words of the texts, and each word's place in that list; -1 ends a piece."""
    flat = b"\n".join(texts).lower().translate(_PIECES).replace(b"\n", b" \n ")
    coded = pc.split_pattern(pa.array([flat], pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
    places, listed = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    no_word = pc.is_in(listed, pa.array(["", "\n"], listed.type)).to_numpy(zero_copy_only=False)
    renumbered = np.where(no_word, -1, np.cumsum(~no_word) - 1).astype(np.int32)
    gap = pc.index(listed, pa.scalar("", listed.type)).as_py()
    return listed.filter(pa.array(~no_word)).cast(pa.string()), renumbered[places[places != gap]]


def word_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``docs`` (lang and text, no nulls), written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch["text"].cast(pa.large_binary()).filter(pc.equal(langs.indices, k))
                ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
                at = 0
                while at < len(texts):
                    end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_bytes, "right")))
                    words, tokens = _tokens(texts[at:end].to_pylist())
                    counts = np.bincount(tokens[tokens >= 0], minlength=len(words))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([lang], pa.string()),
                         *(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), v) for v in (
                             words, pa.array(counts, pa.int64()))), pa.array([tokens.tobytes()], pa.binary())], schema=_BLOCK)
                    at, number = end, number + 1

    ship(docs.sparkSession)
    return written(docs.select("lang", "text").mapInArrow(run, BLOCK), "phrase-blocks")


def frequent_words(blocks: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, f, number) of the words with ``min_count`` occurrences or more."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    found = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    return written(numbered(found.filter(F.col("f") >= min_count), "number", "frequent"), "frequent-words")


def _windows(ids: np.ndarray) -> np.ndarray:
    """From each place the sequence of up to four ids; those of two and more."""
    padded = np.concatenate([ids, np.full(LEVELS - 1, NONE, ids.dtype)])
    out = np.stack([padded[i:len(ids) + i] for i in range(LEVELS)], 1)
    for i in range(1, LEVELS):
        out[out[:, i - 1] == NONE, i] = NONE
    return out[out[:, 1] != NONE]


def _prefix_sums(keys: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum per prefix of ``words`` ids, of sorted keys that have as many."""
    some = keys[:, words - 1] != NONE
    keys, counts = keys[some], counts[some]
    if not len(keys):
        return keys, counts
    new = np.concatenate([[True], (keys[1:, :words] != keys[:-1, :words]).any(1)])
    out = keys[new].copy()
    out[:, words:] = NONE
    return out, np.add.reduceat(counts, np.flatnonzero(new))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Prefix partition: by the first three ids, of which a pair has but two."""
    h = np.zeros(len(keys), np.uint64)
    for i in range(3):
        h = (h ^ keys[:, i].astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(parts)).astype(np.int64)


def _dealt(runs: list[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, keys, counts) of the entries of sorted runs: sequences of three and four words,
    and the sums of pairs."""
    pairs = [_prefix_sums(k, c, 2) for k, c in runs]
    keys = np.concatenate([k[k[:, 2] != NONE] for k, _ in runs] + [k for k, _ in pairs])
    counts = np.concatenate([c[k[:, 2] != NONE] for k, c in runs] + [c for _, c in pairs])
    part = _part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    for p, rows in zip(found, np.split(order, starts[1:]), strict=True):
        k = np.ascontiguousarray(keys[rows].T)  # by column, which compresses well
        yield pa.RecordBatch.from_arrays([pa.array([p]), *(pa.array([pa.compress(
            b, codec="zstd", asbytes=True)], pa.binary()) for b in (k.tobytes(), counts[rows].astype(np.int64).tobytes()))],
            schema=_RUN)


def phrase_runs(blocks: DataFrame, numbers: DataFrame, n_ids: int, parts: int, room: int = ROOM) -> DataFrame:
    """Runs (part, keys, counts) of all tasks' tries."""
    kind = id_type(n_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = HatTrie(n_ids, room=room), [], 0

        def leaving(runs):
            nonlocal held, size
            for keys, counts in runs:
                held.append((keys, counts))
                size += len(keys)
                if size >= GATHERED:
                    yield from _dealt(held, parts)
                    held, size = [], 0

        for batch in batches:
            for i in range(batch.num_rows):
                places = np.frombuffer(batch["tokens"][i].as_buffer(), np.int32)
                of = np.full(int(places.max(initial=-1)) + 2, NONE, kind)  # the last stands for -1
                of[batch["places"][i].values.to_numpy(zero_copy_only=False)] = batch["numbers"][i].values.to_numpy(zero_copy_only=False)
                keys = _windows(of[places])
                for at in range(0, len(keys), 1 << 19):
                    some = keys[at:at + (1 << 19)]
                    yield from leaving(trie.add(some, np.ones(len(some), np.int64)))
        yield from leaving(trie.rest())
        if held:
            yield from _dealt(held, parts)

    both = blocks.select("block", "tokens").join(numbers.hint("merge"), "block")
    return both.select("tokens", "places", "numbers").mapInArrow(run, "part long, keys binary, counts binary")


def merged_phrases(runs: DataFrame, n_ids: int, parts: int, min_count: int) -> DataFrame:
    """(phrase, f): the phrases of two to four numbers with ``min_count`` occurrences or more. A
    task reads a partition's runs one after another and keeps its different entries only."""
    kind = id_type(n_ids)

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        return counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    def kept(held: list) -> pa.RecordBatch:
        keys, counts = merged(held)
        order = in_order(keys)
        keys, counts = keys[order], counts[order]
        pair = keys[:, 2] == NONE
        found = [(keys[pair], counts[pair], 2), *((*_prefix_sums(keys, counts, n), n) for n in (3, 4))]
        rows, fs = [], []
        for k, c, n in found:
            enough = c >= min_count
            rows += k[enough][:, :n].astype(np.int64).tolist()
            fs += c[enough].tolist()
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(fs, pa.int64())], schema=_PHRASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, fresh, least = None, [], 0, 0
        for batch in batches:
            for p, k, c in zip(*(batch.column(i) for i in range(3)), strict=True):
                if p.as_py() != now:
                    if held:
                        yield kept(held)
                    now, held, fresh, least = p.as_py(), [], 0, 0
                counts = np.frombuffer(_unpacked(c), np.int64)
                held.append((np.frombuffer(_unpacked(k), kind).reshape(LEVELS, -1).T, counts))
                fresh += len(counts)
                if fresh > max(GATHERED, least):
                    held = [merged(held)]
                    fresh, least = 0, len(held[0][1])
        if held:
            yield kept(held)

    return (runs.repartition(parts, "part").sortWithinPartitions("part")
            .mapInArrow(run, "phrase array<long>, f long"))


def _unpacked(packed: pa.Scalar) -> bytes:
    """What ``pa.compress`` packed (zstd; its frame knows the size)."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed.as_buffer())


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrase, a, l, r, score of the phrases by their lowest-scoring cut (ties: the earliest)."""
    counts = phrases.select("phrase", "f").union(words.select(F.array("number"), "f"))
    cuts = phrases.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("phrase", 1, F.col("k")),
                             "right": F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))})
    both = cuts.join(counts.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left").join(
        counts.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    wide = [F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")]
    score = F.call_function("div", wide[0] * F.lit(2_000_000).cast("decimal(7,0)"), wide[1] + wide[2])
    best = both.withColumn("score", score).groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("phrase", "a", "cut.l", "cut.r", "cut.score")


def nested(phrases: DataFrame) -> DataFrame:
    """(phrase, over): the largest count of a longer phrase that holds the phrase's words in a row."""
    longer = phrases.filter(F.size("phrase") > 2)
    inside = [F.slice("phrase", i, n) for size in (3, 4) for n in range(2, size) for i in range(1, size - n + 2)
              if size == 4 or n == 2]
    three, four = inside[:2], inside[2:]
    parts = F.when(F.size("phrase") == 3, F.array(*three)).otherwise(F.array(*four))
    return longer.select(F.explode(parts).alias("phrase"), "f").groupBy("phrase").agg(F.max("f").alias("over"))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
         nested_percent: int = NESTED_PERCENT, top: int = TOP, block_bytes: int = BLOCK_BYTES, room: int = ROOM,
         part_words: int = PART_WORDS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is ``und``. Empty tables, and languages without a phrase
    of ``min_count`` occurrences, give no row. Repeated rows count each time. Texts of any length
    are counted whole. Ties rank by count, then by phrase. Other columns are not read."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    blocks = word_blocks(rows, block_bytes)
    words = frequent_words(blocks, min_count)
    n_ids, n_words = words.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    parts = -(-n_words // part_words) or 1
    runs = phrase_runs(blocks, numbers_of_blocks(blocks, words, ["lang", "word"]), n_ids, parts, room)
    phrases = written(merged_phrases(runs, n_ids, parts, min_count), "phrases")
    left = scored(phrases, words).join(nested(phrases), "phrase", "left").filter(
        F.col("over").isNull() | (100 * F.col("over") < nested_percent * F.col("a"))).drop("over")
    spelt = (left.select("phrase", F.posexplode("phrase").alias("place", "number"))
             .join(words.select("number", "lang", "word"), "number")
             .groupBy("phrase").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
             .select("phrase", "lang", F.array_join(F.col("w.word"), " ").alias("text")))
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    ranked = left.join(spelt, "phrase").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
