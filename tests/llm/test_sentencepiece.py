import random

import public_tokenizers
import pytest
from edge import edge_docs, no_docs, rows_of

from govlens.llm import sentencepiece_codec as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return S.Model(PATH)


ALPHABETS = [["a", "b", "e", "th", "ing", "on", "er", " ", "  ", "t", "s", "1", "=", "ü"],
             ["a", "b", "the", "in", "s", "n", "on", "t", "e"], ["漢", "a", "🙂", " ", "\n", "the", "é"],
             ["x y", " ", "   ", "the ", "of ", "and "], ["a"], [" "], ["▁", "a "]]


def texts(seed, n, longest):
    rnd = random.Random(seed)
    for _ in range(n):
        a = rnd.choice(ALPHABETS)
        yield "".join(rnd.choice(a) for _ in range(rnd.randrange(1, longest)))


def scan(model, text, size):
    y, margin, chunks = S.escaped(text), 2 * model.longest, []
    for begin in range(0, len(y), size):
        lo, last = max(0, begin - margin), begin + size >= len(y)
        part = y[lo:begin + size + margin]
        chunks.append(S.Chunk(model, part, lo, begin, lo + len(part) if last else begin + size, last))
    states = S.cut_states([c.matrix() for c in chunks])
    ids = [c.traced(c.entries[a], c.exits[b]) for c, (a, b) in zip(chunks, states, strict=True)]
    return [x for i in ids for x in i], "".join(S.decode_part(model, i) for i in ids)


@pytest.mark.parametrize("size", [64, 97, 130])
def test_scan_equals_the_library(model, size):
    for text in texts(size, 120, 400):
        ids, said = scan(model, text, size)
        assert ids == model.library.encode(text)
        assert said == " " + text.replace("▁", " ")


def test_product_is_associative(model):
    y = S.escaped("the inhabitants of anothertowninthere " * 12)
    cs = [S.Chunk(model, y, 0, b, min(b + 100, len(y)), b + 100 >= len(y)) for b in range(0, len(y), 100)]
    m = [c.matrix() for c in cs][:4]
    left = S.max_plus(S.max_plus(S.max_plus(m[0], m[1]), m[2]), m[3])
    right = S.max_plus(m[0], S.max_plus(m[1], S.max_plus(m[2], m[3])))
    assert (left == right).all() and left.max() == 0


def test_documents_and_giants(spark, model):
    rows = [(i, t) for i, t in enumerate(texts(9, 30, 3000))] + [(None, "a" * 2000), (3, "wordswithoutspaces" * 90)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, ids string")
    out = rows_of(S.encode(df, PATH, chunk=300))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == sorted((str(i), model.library.encode(t)) for i, t in rows)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert max(r["n_chunks"] for r in out) > 5
    said = sorted((str(r["doc_id"]), r["text"]) for r in rows_of(S.decode(S.encode(df, PATH, chunk=300), PATH)))
    assert said == sorted((str(i), t.replace("▁", " ")) for i, t in rows)


def test_edges(spark, model):
    docs = edge_docs(spark, "place")
    out = rows_of(S.encode(docs, PATH))
    want = sorted((str(r.doc_id), model.library.encode(r.text or "")) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == want
    assert all(r["round_trip"] for r in out)
    assert S.encode(no_docs(spark), PATH).count() == 0
