import random

import numpy as np
import pytest
from edge import edge_docs, no_docs, rows_of

from govlens.llm import near_dups
from govlens.llm.components import connected_components


def words(text):
    return (text or "").encode().lower().split()


def brute(rows, k, percent):
    """component of each id by comparing all pairs of sets of word tuples."""
    sets = {}
    for i, t in rows:
        w = words(t)
        s = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        sets.setdefault(i, set()).add(frozenset(s))
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and 100 * len(x & y) >= percent * len(x | y):
                        ra, rb = sorted((root(a), root(b)))
                        top[rb] = ra
    return {i: root(i) for i in ids}


def family_docs(seed, families=12, size=14):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    shared = [rnd.choice(vocabulary) for _ in range(30)]  # a passage that many documents hold
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 9, 30, 80, 200]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + max(1, len(w) // 20))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                w += shared
            rows.append((i, " ".join(w)))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_components_against_all_pairs(spark, monkeypatch, seed, k, percent):
    monkeypatch.setattr(near_dups, "MEMBERS", 5)  # several blocks and chunks
    rows = family_docs(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in rows_of(near_dups.near_duplicates(df, k, percent))}
    want = brute(rows, k, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_edges(spark):
    out = rows_of(near_dups.near_duplicates(edge_docs(spark, "component_id"), 3, 85))
    assert len(out) == 16
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_shingles"] == 0 and r["component_id"] == i and r["kept"] for i in (0, 1, 2, 7) for r in by[i])
    assert {r["component_id"] for i in (4, 5, 8) for r in by[i] if i != 8} == {4}
    assert [r["kept"] for r in by[4]] == [True, True] and by[5][0]["kept"] is False
    assert all(r["component_id"] is None and r["kept"] is None for r in by[None])
    assert by[6][0]["n_shingles"] == 29_998
    assert near_dups.near_duplicates(no_docs(spark), 3, 85).count() == 0


def test_kept_rows_have_the_documents_columns(spark):
    docs = edge_docs(spark, "gone")
    kept = near_dups.kept_of_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((str(r["doc_id"]) for r in rows_of(kept)))
    assert "5" not in ids and ids.count("4") == 2 and ids.count("None") == 2


def test_large_group_yields_no_pairs(spark, monkeypatch):
    """600 near copies of one text: links stay linear in the group."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rnd.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    seen = []
    monkeypatch.setattr(near_dups, "verified", lambda pairs, docs, s, f=near_dups.verified: (
        seen.append(pairs.count()), f(pairs, docs, s))[1])
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r["component_id"] for r in rows_of(out)} == {0}
    assert sum(seen) <= 2 * 600


def test_registers_estimate_jaccard():
    rnd = np.random.default_rng(5)
    for j in (0.2, 0.5, 0.85):
        errors = []
        for _ in range(30):
            n = 600
            both = int(2 * n * j / (1 + j))
            x = rnd.integers(0, 2 ** 63, 2 * n - both).astype(np.uint64) * np.uint64(2)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))
            ra, rb = (near_dups.registers(s)[None, :] for s in (a, b))
            errors.append(near_dups.estimate(ra, rb, np.array([n]), np.array([n]))[0] - j)
        assert abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize("words,percent,shared,a,b", [
    (3, 85, 6, 7, 6), (3, 85, 12, 14, 12), (5, 80, 4, 5, 4), (5, 80, 8, 9, 9), (5, 80, 12, 15, 12), (3, 85, 17, 20, 17)])
def test_small_sets_at_the_threshold_share_a_band(words, percent, shared, a, b):
    """Of thousands of pairs of small sets none may be missed, by bands or by the estimate."""
    s = near_dups.Settings(words, percent)
    assert 100 * shared >= percent * (a + b - shared)
    rnd = np.random.default_rng(8)
    missed = dropped = 0
    for _ in range(3000):
        x = near_dups.mix(rnd.integers(0, 2 ** 63, a + b - shared).astype(np.uint64))
        one, two = (near_dups.registers(np.sort(y)) for y in (x[:a], np.concatenate([x[:shared], x[a:]])))
        bands = (one == two)[:s.bands * s.rows].reshape(s.rows, s.bands)
        missed += not bands.all(axis=0).any()
        dropped += near_dups.estimate(one[None], two[None], np.array([a]), np.array([b]))[0] < s.least_estimate
    assert missed == dropped == 0


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(near_dups, "COLUMNS", 7)
    rnd = random.Random(6)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randrange(1, 40)))) for _ in range(9)]
    got = near_dups.shared_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(set(a.tolist()) & set(b.tolist()))


def test_connected_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5, 5), (None, 3)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in top}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
