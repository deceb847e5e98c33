"""Approximate neighbours against brute force: recall, exact scores, edge rows."""

import math

import numpy as np
from edge import rows_of

from govlens.llm import nn_descent as N

SCHEMA = "vec_id long, embedding array<float>, Score int"


def brute(rows, top=20, every=20):
    """Exact answer for valid (id, vector) rows."""
    out = {}
    for q, x in rows:
        if q % every == 0:
            s = sorted((-float(np.dot(np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float))), v)
                       for v, y in rows if v != q)
            out[q] = [(v, -p) for p, v in s[:top]]
    return out


def found(df):
    out = {}
    for r in sorted(rows_of(df), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    """Share of the exact answer found, where a score as large counts (ties)."""
    hits = sum(sum(s >= want[q][-1][1] - 1e-12 for _, s in got.get(q, [])) for q in want)
    return hits / sum(map(len, want.values()))


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = found(N.nearest(df)), brute(rows)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.98
    vec = dict(rows)
    for q, near in got.items():
        for v, s in near:
            assert abs(s - sum(a * b for a, b in zip(vec[q], vec[v]))) < 1e-12


def test_uneven_norms_and_many_copies(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((2500, 12)) * r.lognormal(0, 0.5, (2500, 1))
    x[:600] = x[0]  # a large group of copies
    x[600:900] = x[600] + r.standard_normal((300, 12)) * 1e-3  # and of near copies
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = found(N.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))), brute(rows)
    assert got.keys() == want.keys() and all(len(a) == 20 for a in got.values())
    assert recall(got, want) >= 0.95
    # ties go to the smaller id
    assert [v for v, _ in got[0]] == [v for v, _ in want[0]] or len({round(s, 9) for _, s in want[0]}) > 1


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
            (7, [1.0, math.nan]), (8, [math.inf, 1.0]), (40, [0.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (1, [0.5, 0.5])]
    got = found(N.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)))
    assert got == brute([rows[i] for i in (0, 1, 2, 3)])


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.nearest(df).columns == ["query_id", "rank", "vec_id", "score"] and N.nearest(df).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 1)], SCHEMA)
    assert N.nearest(one).count() == 0
