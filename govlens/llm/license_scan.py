"""License scan: fixed phrases exactly, short license notices with a few edits.

A notice of length m may have k = m // 12 edits. Cut into k + 1 pieces, at least one
piece stands unchanged in any such copy (pigeonhole), so one pass of an Aho-Corasick
automaton over all pieces finds every candidate place; the regex library's
bounded-error matching then verifies the notice around it and gives span and edits.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from govlens.llm.common import ship, texts

# Phrases of consecutive words and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as their words stand after lower-casing and cutting at other characters.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gnu", "this work is licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc0", "dedicated to the public domain by waiving all rights to the work worldwide"),
]
CHARS_PER_EDIT = 12

# Bytes of words: 0-9, a-z (A-Z become these) and all of non-ASCII characters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Match:
    label: str
    first_word: int
    n_words: int
    edits: int
    similarity: float


class Scanner:
    """Compiled notices. ``exact`` and ``fuzzy`` take a text's words joined by spaces."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]], chars_per_edit: int):
        self.phrases = [(f" {p} ", label, p.count(" ") + 1) for p, label in phrases.items()]
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (label, notice) in enumerate(notices):
            k = len(notice) // chars_per_edit
            self.notices.append((label, len(notice), k, regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        if seeds:
            self.automaton.make_automaton()

    def exact(self, joined: str) -> list[Match]:
        found, padded = [], f" {joined} "
        for phrase, label, n in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                found.append(Match(label, padded.count(" ", 1, at + 1), n, 0, 1.0))
                at = padded.find(phrase, at + 1)
        return found

    def fuzzy(self, joined: str) -> list[Match]:
        found, done = [], [-1] * len(self.notices)
        if not self.notices:
            return []
        for end, (size, places) in self.automaton.iter(joined):
            for n, offset in places:
                label, length, k, pattern = self.notices[n]
                start = end + 1 - size - offset  # of the notice, if nothing is edited before the seed
                if start + offset < done[n]:
                    continue  # within a match that is already verified
                a, b = max(0, start - k), start + length + k
                if m := pattern.search(joined, a, b):
                    first = joined.count(" ", 0, m.start() + (joined[m.start():m.start() + 1] == " "))
                    edits = sum(m.fuzzy_counts)
                    found.append((m.start(), m.end(), Match(label, first, len(m[0].split()), edits,
                                                            1 - edits / length)))
                    done[n] = m.end()
        return _best(found)


def _best(found: list[tuple[int, int, Match]]) -> list[Match]:
    """Of overlapping matches the one with the fewest edits (then the longest, then the first)."""
    kept: list[tuple[int, int, Match]] = []
    for a, b, m in sorted(found, key=lambda x: (x[2].edits, x[0] - x[1], x[0])):
        at = bisect.bisect_right(kept, a, key=lambda x: x[1])  # kept ones are disjoint and in order
        if at == len(kept) or kept[at][0] >= b:
            kept.insert(at, (a, b, m))
    return [m for _, _, m in kept]


SCHEMA = ("doc_id long, n_words long, exact array<struct<label:string,first_word:long,n_words:long>>, "
          "fuzzy array<struct<label:string,first_word:long,n_words:long,edits:int,similarity:double>>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
                  notices: list[tuple[str, str]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the places of phrases (``exact``) and
    the verified notices (``fuzzy``: label, first word from 0, words, edits, similarity).

    Null or empty text: no words, empty lists. Null ids and repeated rows stay. Other
    columns are ignored; an empty table gives an empty result. Overlapping places all
    count for phrases; of a notice, matches do not overlap.
    """
    ship(docs.sparkSession)
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("exact", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))),
        ("fuzzy", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                                      ("edits", pa.int32()), ("similarity", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, chars_per_edit)
        for batch in batches:
            n_words, exact, fuzzy = [], [], []
            for text in batch.column(1):
                words = normal_words(text.as_py())
                joined = b" ".join(words).decode()
                n_words.append(len(words))
                exact.append([{"label": m.label, "first_word": m.first_word, "n_words": m.n_words}
                              for m in scanner.exact(joined)])
                fuzzy.append([vars(m) for m in scanner.fuzzy(joined)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(
                pa.array(c, kinds.field(i).type) for i, c in ((1, n_words), (2, exact), (3, fuzzy)))], schema=kinds)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
