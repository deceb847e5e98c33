"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

The model is BPE with byte fallback. Its encoding of a text is the only sequence of
pieces in which every piece and every neighbouring pair encodes to itself, so it is the
best path of a max-plus automaton: an arc per piece, weight 0 where the pair is stable
and minus infinity where it is not (a test compares this with the library).

A giant text is cut into chunks of equal length, anywhere. The state at a cut is the
piece that covers the last character before it. Each chunk, on its own, yields the
matrix of best weights from each entry state to each exit state; the matrices are
combined by the associative max-plus product, which gives the state at every cut; then
each chunk is traced back on its own. Within a chunk, pieces never span a place where a
space follows another character, so only the stretches before the first and after the
last such place need arcs; the library encodes what lies between. A chunk without such a
place is handled by arcs alone.

Texts of up to a chunk go to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import new_path, ship, texts

CHUNK = 32_768
SPACE = "▁"
NEVER = -np.inf

State = tuple[int, int]  # start and end of the piece that covers the character before a cut


class Model:
    """A BPE model file with the arcs of its automaton."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.vocab_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(names) if not (
            self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i)
            or self.library.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces with a space inside; texts can't be cut before spaces")
        self.rank = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = {b: self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.longest = max(map(len, self.ids))
        self.stable_pair = lru_cache(1_000_000)(self._stable_pair)
        self.stable = lru_cache(200_000)(lambda p: self._merged(p) == [p])

    def _merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-ranked neighbours are merged, leftmost first."""
        parts = list(text)
        while True:
            best = max(((self.rank[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                        if a + b in self.rank), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = ["".join(parts[i:i + 2])]

    def _stable_pair(self, a: str, b: str) -> bool:
        return self._merged(a + b) == [a, b]

    def weight(self, a: str, b: str) -> float:
        """Of the arc of piece ``b`` after ``a`` (empty: the text's start)."""
        if not a or a not in self.ids or b not in self.ids or (b[0] == SPACE and a[-1] != SPACE):
            return 0.0
        return 0.0 if self.stable_pair(a, b) else NEVER

    def pieces_at(self, text: str, at: int) -> list[str]:
        found = [p for n in range(1, self.longest + 1)
                 if len(p := text[at:at + n]) == n and p in self.ids and self.stable(p)]
        return found if text[at] in self.ids else [text[at], *found]

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def middle(self, text: str) -> list[int]:
        """Ids of a stretch that begins with a space and ends before one or at the end."""
        return self.library.encode(text[1:].replace(SPACE, " "))

    def states(self, text: str, cut: int) -> list[State]:
        """Pieces that may cover the character before ``cut``, in a fixed order."""
        return [(p, p + len(x)) for p in range(max(0, cut - self.longest), cut)
                for x in self.pieces_at(text, p) if p + len(x) >= cut]


def escaped(text: str) -> str:
    """The text as the model sees it: spaces as marks, one more in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


_BREAK = regex.compile(rf"(?<=[^{SPACE}]){SPACE}")


class Chunk:
    """[begin, end) of an escaped text, of which ``text`` is the part from ``origin`` on that
    reaches a longest piece beyond either side. Positions are the whole text's."""

    def __init__(self, model: Model, text: str, origin: int, begin: int, end: int, last: bool):
        self.model, self.text, self.origin, self.begin, self.end = model, text, origin, begin, end
        self.entries: list[State] = [(0, 0)] if begin == 0 else self._states(begin)
        self.exits: list[State] = self._states(end)
        if last:
            self.exits = [s for s in self.exits if s[1] == end]
        breaks = [m.start() + origin for m in _BREAK.finditer(text)]
        reach = max(e for _, e in self.entries)
        first = min((b for b in breaks if b >= reach), default=None)
        tail = max((b for b in breaks if b <= min(s for s, _ in self.exits)), default=None)
        self.first, self.tail = (first, tail) if first is not None and tail is not None and first <= tail else (None, None)

    def _states(self, cut: int) -> list[State]:
        return [(a + self.origin, b + self.origin) for a, b in self.model.states(self.text, cut - self.origin)]

    def _piece(self, s: State) -> str:
        return self.text[s[0] - self.origin:s[1] - self.origin]

    def _paths(self, begin: list[State], to: int) -> dict[State, tuple[np.ndarray, np.ndarray, list]]:
        """For each piece that a path from ``begin`` takes and that starts before ``to``: its best
        weight from each of them, and which of the pieces before it that goes through."""
        ending: dict[int, list[State]] = {}
        best: dict[State, tuple[np.ndarray, np.ndarray, list]] = {}
        unit = np.where(np.eye(len(begin), dtype=bool), 0.0, NEVER)
        for i, s in enumerate(begin):
            best[s] = (unit[i], np.full(len(begin), -1), [])
            ending.setdefault(s[1], []).append(s)
        for at in range(min(ending), to):
            before = ending.pop(at, None)
            if not before:
                continue
            for piece in self.model.pieces_at(self.text, at - self.origin):
                ways = np.stack([best[s][0] + self.model.weight(self._piece(s), piece) for s in before])
                top = ways.max(axis=0)
                if (top > NEVER).any():
                    s = (at, at + len(piece))
                    best[s] = (top, ways.argmax(axis=0), before)
                    ending.setdefault(s[1], []).append(s)
        return best

    def _vector(self, best: dict, size: int, goal: State) -> np.ndarray:
        return best[goal][0] if goal in best else np.full(size, NEVER)

    def matrix(self) -> np.ndarray:
        """Best weight from each entry to each exit."""
        n = len(self.entries)
        if self.first is None:
            best = self._paths(self.entries, self.end)
            return np.stack([self._vector(best, n, x) for x in self.exits], axis=1)
        head = self._paths(self.entries, self.first)
        to_first = np.max([v[0] for s, v in head.items() if s[1] == self.first], axis=0)
        tail = self._paths([(self.tail, self.tail)], self.end)
        return to_first[:, None] + np.array([self._vector(tail, 1, x)[0] for x in self.exits])[None, :]

    def _trace(self, begin: list[State], start: State, goals: list[State], to: int) -> list[int]:
        best, i = self._paths(begin, to), begin.index(start)
        at = max((g for g in goals if g in best), key=lambda g: best[g][0][i])
        out: list[list[int]] = []
        while at != start or best[at][2]:
            out.append(self.model.piece_ids(self._piece(at)))
            at = best[at][2][best[at][1][i]]
        return [x for ids in reversed(out) for x in ids]

    def traced(self, entry: State, exit: State) -> list[int]:
        """Ids of the pieces after ``entry`` up to and with ``exit``."""
        if entry == exit:
            return []
        if self.first is None:
            return self._trace(self.entries, entry, [exit], self.end)
        head = [] if entry[1] == self.first else self._trace(
            self.entries, entry, [(a, self.first) for a in range(entry[1], self.first)], self.first)
        middle = self.model.middle(self.text[self.first - self.origin:self.tail - self.origin]) if (
            self.tail > self.first) else []
        start = (self.tail, self.tail)
        return head + middle + self._trace([start], start, [exit], self.end)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def cut_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) numbers of each chunk on the best path from the first chunk's only entry to
    a last exit."""
    forward = [np.zeros((1, 1))]
    for m in matrices:
        forward.append(max_plus(forward[-1], m))
    at = int(forward[-1][0].argmax())
    out = []
    for v, m in zip(reversed(forward[:-1]), reversed(matrices), strict=True):
        before = int((v[0] + m[:, at]).argmax())
        out.append((before, at))
        at = before
    return out[::-1]


_WORKER: dict = {}


def _model(path: str) -> Model:
    if path not in _WORKER:
        _WORKER[path] = Model(path)
    return _WORKER[path]


def _chunk_rows(chunk: int, margin: int):
    """Rows of (doc_id, text) to rows of (doc_id, place, last, origin, part)."""
    names = ["row", "place", "last", "origin", "part"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = escaped(text.as_py())
                for begin in range(0, len(whole), chunk):
                    lo = max(0, begin - margin)
                    one = [row, begin // chunk, begin + chunk >= len(whole), lo, whole[lo:begin + chunk + margin]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names)

    return run


PART = "row long, place long, last boolean, origin long, part string"


def _chunk(model: Model, size: int, place: int, last: bool, origin: int, part: str) -> Chunk:
    begin = place * size
    return Chunk(model, part, origin, begin, origin + len(part) if last else begin + size, last)


def _giants(giants: DataFrame, path: str, size: int) -> DataFrame:
    """(row, place, ids, decoded) of the chunks of giant texts."""
    model = Model(path)
    margin = 2 * model.longest
    if size < 4 * margin:
        raise ValueError(f"chunks of {size} characters; at least {4 * margin}")
    parts_at = new_path(giants.sparkSession, "chunks")
    giants.mapInArrow(_chunk_rows(size, margin), PART).write.option("compression", "zstd").parquet(parts_at)
    parts = giants.sparkSession.read.schema(PART).parquet(parts_at).repartition("row", "place")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = _chunk(_model(path), size, r["place"], r["last"], r["origin"], r["part"]).matrix()
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in (
                    (r["row"], pa.int64()), (r["place"], pa.int64()), (m.shape[1], pa.int32()),
                    (m.ravel().tolist(), pa.list_(pa.float64())))], ["row", "place", "exits", "m"])

    def states(rows) -> list[tuple[int, int]]:
        return cut_states([np.array(r["m"]).reshape(-1, r["exits"]) for r in rows])

    @F.udf("array<struct<place:long,entry:int,exit:int>>")
    def scan(rows):
        rows = sorted(rows, key=lambda r: r["place"])
        return [(r["place"], a, b) for r, (a, b) in zip(rows, states(rows), strict=True)]

    cuts = (parts.mapInArrow(matrices, "row long, place long, exits int, m array<double>")
            .groupBy("row").agg(F.collect_list(F.struct("place", "exits", "m")).alias("rows"))
            .select("row", F.explode(scan("rows")).alias("c")).select("row", "c.*"))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for r in batch.to_pylist():
                c = _chunk(model, size, r["place"], r["last"], r["origin"], r["part"])
                entry, exit = c.entries[r["entry"]], c.exits[r["exit"]]
                ids = c.traced(entry, exit)
                said = c.text[entry[1] - c.origin:exit[1] - c.origin].replace(SPACE, " ")
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in (
                    (r["row"], pa.int64()), (r["place"], pa.int64()), (ids, pa.list_(pa.int32())),
                    (decode_part(model, ids) == said, pa.bool_()))], ["row", "place", "ids", "same"])

    return parts.join(cuts, ["row", "place"]).mapInArrow(
        trace, "row long, place long, ids array<int>, same boolean")


def decode_part(model: Model, ids: list[int]) -> str:
    """The text of a chunk's ids. Before the library drops the mark in front of a text, a
    line end's byte stands there; no character's bytes are spread over chunks."""
    front = model.piece_ids("\n")
    return model.library.decode([*front, *ids])[1:]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (the library's encoding, without begin or end),
    n_tokens, n_chunks and round_trip (decoding the ids gives the text back, with the model's
    space mark U+2581 read as a space).

    Null or empty text: no ids. Null ids and repeated rows stay; other columns are ignored;
    an empty table gives an empty result. Texts of any length are encoded whole; a giant
    text's chunks are spread over tasks, its ids end up in one row as its text was in one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = texts(docs, id_col, text_col)
    names = ["doc_id", "ids", "n_tokens", "n_chunks", "round_trip"]
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                        T.StructField("n_tokens", T.LongType()), T.StructField("n_chunks", T.LongType()),
                        T.StructField("round_trip", T.BooleanType())])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _model(path).library
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                some = part.column(1).to_pylist()
                ids = library.encode(some, num_threads=1)
                same = [a == b.replace(SPACE, " ") for a, b in zip(library.decode(ids), some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()),
                     pa.array([min(1, len(x)) for x in some], pa.int64()), pa.array(same, pa.bool_())], names)

    few = rows.filter(F.length("text") <= chunk).mapInArrow(small, out)
    # rows of giant texts get a number of their own, as ids may be null or repeated
    at = new_path(spark, "giants")
    rows.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()).write.option(
        "compression", "zstd").parquet(at)
    giants = spark.read.schema("doc_id long, text string, row long").parquet(at)
    if giants.isEmpty():
        return few
    whole = _giants(giants.select("row", "text"), path, chunk).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("c"), F.every("same").alias("round_trip"))
    many = giants.select("doc_id", "row").join(whole, "row").select(
        "doc_id", F.flatten("c.ids").alias("ids"), F.aggregate("c.ids", F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias("n_tokens"),
        F.size("c").cast("long").alias("n_chunks"), "round_trip")
    return few.unionByName(many)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null ids: an empty text."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _model(path).library
        for batch in batches:
            said = library.decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, "doc_id long, text string")
