import math
import zlib
from collections import Counter

import pytest
from edge import edge_docs, no_docs, rows_of

from govlens.llm import lm_score

START, END = "<start>", "<end>"


def weights_by_em(cells, uniform):
    """Mixture weights of weighted (p2, p1, tokens) cells: fifty rounds of expectation-maximisation."""
    w = [1 / 3] * 3
    for _ in range(50):
        sums = [0.0] * 3
        for p2, p1, tokens in cells:
            parts = [a * p for a, p in zip(w, (p2, p1, uniform), strict=True)]
            for j in range(3):
                sums[j] += tokens * parts[j] / sum(parts)
        whole = sum(c[2] for c in cells)
        w = [(x + 0.001) / (whole + 0.003) for x in sums]
    return w


def stepped(p):
    """A probability on the grid of quarter powers of two, down to 2^-160 (none: 0)."""
    q = max(round(4 * math.log2(p)), -640) if p else -640
    return 2.0 ** (q / 4) if q > -640 else 0.0


def brute(rows):
    """Scores by plain counters; weights from documents of remainder 1, each token left out of the counts."""
    def part(i):
        return None if i is None else zlib.crc32(str(i).encode()) % 10

    toks = [(i, [START, *[w.decode() for w in (t or "").encode().lower().split()], END]) for i, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, t in toks:
        if part(i) != 0:
            uni.update(t[1:])
            bi.update(zip(t, t[1:], strict=False))
            ctx.update(t[:-1])
    n, v = sum(uni.values()), len(uni)
    level = lambda c: math.ceil(math.log2(c + 1))
    cells = Counter()
    for i, t in toks:
        if part(i) == 1:
            for u, w in zip(t, t[1:], strict=False):
                c = ctx[u] - 1
                cells[level(c), stepped((bi[u, w] - 1) / max(c, 1)), stepped((uni[w] - 1) / max(n - 1, 1))] += 1
    per = {k: [(p2, p1, m) for (at, p2, p1), m in sorted(cells.items()) if at == k] for k in {c[0] for c in cells}}
    weights = {k: weights_by_em(c, 1 / (v + 1)) for k, c in per.items()}
    every = weights_by_em([c for k in sorted(per) for c in per[k]], 1 / (v + 1)) if cells else [1 / 3] * 3
    top = max(weights, default=None)
    out = []
    for i, t in toks:
        score = base = known = 0
        for u, w in zip(t, t[1:], strict=False):
            k = level(ctx[u])
            a = weights.get(k, every if top is None or k < top else weights[top])
            p2, p1 = bi[u, w] / max(ctx[u], 1), uni[w] / max(n, 1)
            score += math.log10(a[0] * p2 + a[1] * p1 + a[2] / (v + 1))
            base += math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1)))
            known += uni[w] > 0
        out.append((str(i), part(i) == 0, len(t) - 1, known, n, base, score))
    return sorted(out)


def check(df, **options):
    got = sorted((str(r["doc_id"]), *list(r.values())[1:]) for r in rows_of(lm_score.score_documents(df, **options)))
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_blocks_smaller_than_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 20_000)
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3), block_tokens=700)


def test_edges(spark):
    check(edge_docs(spark, "score"))
    check(edge_docs(spark, "number"), block_tokens=50)
    assert lm_score.score_documents(no_docs(spark)).count() == 0
    check(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))  # held out: none
    assert zlib.crc32(b"12") % 10 != 0


def test_held_out_texts_teach_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    other = spark.createDataFrame([(i, "something else " * 9 if i in out else t) for i, t in rows], "doc_id long, text string")
    a, b = ({r.doc_id: (r.base_score, r.score) for r in lm_score.score_documents(x).collect()} for x in (df, other))
    assert out and all(a[i] == pytest.approx(b[i], rel=1e-12) for i, _ in rows if i not in out)
    assert any(a[i] != b[i] for i in out)


def test_weights_prefer_the_better_estimate(spark):
    """Tokens that the bigram foretells: its weight wins where contexts are frequent."""
    cells = [(9, -1, -40, 1000), (1, lm_score.FLOOR, -20, 1000)]
    w = lm_score.learned(cells, 1e-6)
    assert w[9][0] > 0.99 and w[1][1] > 0.99
    assert all(abs(sum(x) - 1) < 1e-9 for x in w.values())


def test_model_beats_base_on_held_out_documents(spark):
    df = lm_score.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    a = df.filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert a[0] > a[1]
