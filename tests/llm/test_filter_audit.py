"""Filter audit against brute force, and the document-term matrix it reads."""

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from edge import edge_docs, no_docs, rows_of
from pyspark.sql import functions as F

from govlens.llm import filter_audit as A
from govlens.llm import term_matrix as M
from govlens.llm.dictionary import numbered_words

WORDS = re.compile("[^\x20\x09-\x0d]+")


def failed(docs):
    """Failed filters of (doc_id, text, lang) rows, from the definition."""
    out = []
    for d, text, _ in docs:
        t = text or ""
        w = WORDS.findall(t)
        fails = [("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)),
                 ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)), ("D", bool(re.search("[#$%&*|]", t))),
                 ("E", d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in docs))]
        out.append({k for k, bad in fails if bad})
    return out


def brute(docs, labels):
    fails = failed(docs)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        rows = [(d, f) for (d, _, lang), f in zip(docs, fails) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = {}
        for order in permutations("ABCDE"):
            left = rows
            for i, k in enumerate(order):
                gone, stay = [r for r in left if k in r[1]], [r for r in left if k not in r[1]]
                shapley[k] += len(gone)
                steps["".join(order), i + 1] = (len(stay), len(gone), sum(k in f for _, f in rows) - len(gone),
                                                sum(f == {k} for _, f in rows), sum(d in good for d, _ in gone),
                                                sum(d in toxic for d, _ in gone))
                left = stay
        out |= {(part, o, s): (*v, shapley[o[s - 1]]) for (o, s), v in steps.items()}
    return out


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows_of(df)}


LABELS = "doc_id long, quality int, toxic int"


def test_audit_equals_brute_force(spark):
    body = " ".join(f"w{i}" for i in range(120))
    docs = [(1, body, "en"), (2, body, "en"), (2, body, "en"), (3, body, None), (4, body.upper(), ""), (5, "a " * 150, "de"),
            (6, body + " #", "de"), (7, None, "de"), (8, "", "en"), (None, body, "en"), (None, "x", "fr"), (9, "É" * 9 + "A", "fr"),
            (10, "   ", "fr"), (11, body + "|", "en"), (12, body + "|", "de")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (7, 1, None), (None, 1, 1), (12, 1, 1)]
    got = A.audit_filters(spark.createDataFrame(docs, "doc_id long, text string, lang string"),
                          spark.createDataFrame(labels, LABELS), block_bytes=200)
    assert result(got) == brute(docs, labels)


def test_edge_rows_and_clashing_columns(spark):
    docs = edge_docs(spark, "n_words").withColumns({"lang": F.lit(None).cast("string"), "Fails": F.lit(1), "part": F.lit("x")})
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = A.audit_filters(docs, spark.createDataFrame([], LABELS))
    assert result(got) == brute(rows, [])


def test_no_documents(spark):
    assert A.audit_filters(no_docs(spark).withColumn("lang", F.lit("en")), spark.createDataFrame([], LABELS)).count() == 0


def test_matrix_holds_every_word_under_one_number(spark):
    texts = ["b a b", "", "a c  a\tA", "b " * 40, " "]
    docs = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "doc_id long, part string, text string")
    blocks = M.word_blocks(docs.repartition(2), block_bytes=8)
    words = numbered_words(blocks)
    of = {}
    for r in words.collect():
        assert of.setdefault(r["number"], r["word"]) == r["word"]
    assert len(set(of.values())) == len(of) == len({w for t in texts for w in WORDS.findall(t)})
    seen = {}
    for r in rows_of(M.csr_shards(blocks, words)):
        ptr, ind, dat = (M.unpacked(pa.scalar(r[c], pa.binary()), t) for c, t in (("indptr", np.int64), ("indices", np.int64), ("data", np.int32)))
        for i, d in enumerate(r["doc_id"]):
            columns = ind[ptr[i]:ptr[i + 1]]
            assert (np.diff(columns) > 0).all()
            seen[d] = {of[c]: n for c, n in zip(columns.tolist(), dat[ptr[i]:ptr[i + 1]].tolist())}
    assert seen == {i: {w: WORDS.findall(t).count(w) for w in WORDS.findall(t)} for i, t in enumerate(texts)}
