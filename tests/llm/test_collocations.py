"""Collocations and the HAT-trie against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from edge import edge_docs, no_docs, rows_of
from pyspark.sql import functions as F

from govlens.llm import collocations as C
from govlens.llm.hat_trie import HatTrie


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, min_count, top, percent=80):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = []
    for lang in n:
        rows = []
        for p, a in cands.items():
            w = p[1:]
            if p[0] != lang or any(q[0] == lang and len(q) > len(p) and 100 * b >= percent * a and any(
                    q[1:][i:i + len(w)] == w for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            s, k = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            rows.append((-s, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows_of(df))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300, "room": 40, "part_words": 50}])
def test_equals_brute_force(spark, options):
    r = np.random.default_rng(3)
    vocab = [*"abcdefgh", "É", "Ab", "漢字", "x y", "\x00"]
    docs = [("".join(vocab[int(w) % 13] + str(s) for w, s in zip(r.zipf(1.4, 80), r.choice([" ", " ", " ", "\t ", ". ", "\n", "  "], 80))),
             ["en", None, ""][i % 3]) for i in range(60)]
    docs += [("the end of the line " * 30, "en"), (None, "en"), ("", "fr"), (" \t\n", None)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    want = brute(docs, 6, 25)
    assert len(want) > 50
    assert result(C.mine(df, min_count=6, top=25, **options)) == want


def test_edge_rows_and_no_rows(spark):
    docs = edge_docs(spark, "phrase").withColumns({"lang": F.lit("en"), "F": F.lit(1)})
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert result(C.mine(docs, min_count=4)) == brute(rows, 4, 2000)
    assert C.mine(no_docs(spark).withColumn("lang", F.lit("en"))).count() == 0
    assert C.mine(docs, min_count=10**9).count() == 0


@pytest.mark.parametrize("ids,burst,room,rows,kind", [
    (5, 4, 50, 400, np.int32), (50, 20, 300, 3000, np.int32), (1000, 64, 5000, 9000, np.int32), (3, 2, 10**6, 500, np.int64)])
def test_trie_loses_nothing(ids, burst, room, rows, kind):
    r, want, got, runs = np.random.default_rng(ids), Counter(), Counter(), []
    trie = HatTrie(ids, burst, room)
    for _ in range(6):
        keys = (r.zipf(1.5, (rows, 4)) % ids).astype(kind)
        size = r.integers(1, 5, rows)
        for i in range(4):
            keys[size <= i, i] = -1
        want.update(map(tuple, keys.tolist()))
        runs += trie.add(keys, np.ones(rows, np.int64))
        assert trie.size <= room
    runs += trie.rest()
    for keys, counts in runs:
        listed = [tuple(k) for k in keys.tolist()]
        assert listed == sorted(set(listed))
        got.update(dict(zip(listed, counts.tolist())))
    assert got == want
