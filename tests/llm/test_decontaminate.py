import random

import pytest
from edge import edge_docs, no_docs, rows_of

from govlens.llm import decontaminate as D

BENCH = "/root/testdata/sf0.001/benchmark.parquet"


def levenshtein_within(pattern, text):
    """Fewest edits between the pattern and any part of the text (plain table)."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_exact_passages_are_found_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet(BENCH)
    items = [(b.item_id, D.normal(b.text)) for b in bench.collect()]
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in rows_of(D.with_leaks(docs, bench))}
    for d in docs.collect():
        t = D.normal(d.text or "")
        assert {i for i, b in items if b in t} <= got[d.doc_id]
        for i in got[d.doc_id]:
            b = dict(items)[i]
            assert levenshtein_within(b, t) <= D.budget(len(b), D.Q, D.EDITS_PERCENT)


def edited(rnd, text, k):
    s = list(text)
    for _ in range(k):
        p = rnd.randrange(len(s))
        kind = rnd.choice("ids")
        if kind == "i":
            s.insert(p, rnd.choice("qzxk"))
        elif kind == "d" and s[p] != " " and " " not in (s[p - 1], s[(p + 1) % len(s)]):
            del s[p]
        elif s[p] != " ":
            s[p] = rnd.choice("qzxk")
    return "".join(s)


def test_edited_copies_within_the_budget(spark):
    rnd = random.Random(1)
    items = [(b.item_id, D.normal(b.text)) for b in spark.read.parquet(BENCH).collect()]
    index = D.Index(items, D.Q, D.EDITS_PERCENT)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:40]
    for _ in range(150):
        i, item = rnd.choice(items)
        k = rnd.randrange(D.budget(len(item), D.Q, D.EDITS_PERCENT) + 1)
        text = rnd.choice(texts)[:1500] + " " + edited(rnd, item, k) + " " + rnd.choice(texts)[:300]
        found = [x for x in D.find_leaks(index, [text])[0] if x["item_id"] == i]
        best = levenshtein_within(item, D.normal(text))
        assert best <= k and found and min(x["edits"] for x in found) == best


def test_truncated_copies_beside_other_documents(spark):
    """A copy at a document's end that lacks up to k characters is found as in a pass of its own."""
    items = [(b.item_id, D.normal(b.text)) for b in spark.read.parquet(BENCH).collect()]
    index = D.Index(items, D.Q, D.EDITS_PERCENT)
    for i, item in items[:4]:
        k = D.budget(len(item), D.Q, D.EDITS_PERCENT)
        for cut in range(1, k + 1):
            head, tail = item[cut:], item[:-cut]
            if " " in (head[0], tail[-1]):
                continue  # white space at the ends goes, and with it one more character
            for text in (head, head + " and more", tail, "some more " + tail):
                alone = D.find_leaks(index, [text])[0]
                own = [x for x in alone if x["item_id"] == i]
                assert own and own[0]["edits"] <= cut
                for before, after in (("other text", "other text"), (item[:cut], item[-cut:]), (item, item)):
                    assert D.find_leaks(index, [before, text, after])[1] == alone


def test_items_with_the_separator_stay_in_one_document():
    for half in ("b", "some half"):
        index = D.Index([(1, f"{half}\0{half}")], D.Q, D.EDITS_PERCENT)
        found = D.find_leaks(index, [half, f"{half}\0{half}", half])
        assert [[(x["start"], x["edits"]) for x in f] for f in found] == [[], [(0, 0)], []]


def test_segments_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_CHARS", 3000)
    items = [(b.item_id, D.normal(b.text)) for b in spark.read.parquet(BENCH).collect()]
    index = D.Index(items, D.Q, D.EDITS_PERCENT)
    filler = "lorem ipsum dolor sit amet " * 400
    for place in range(2000, 4200, 173):
        text = filler[:place] + " " + items[3][1] + " " + filler
        assert [x["item_id"] for x in D.find_leaks(index, ["", text, None])[1]] == [items[3][0]]
    monkeypatch.undo()
    docs = spark.createDataFrame([(1, filler + items[5][1]), (2, filler), (3, items[7][1] + items[8][1])], "doc_id long, text string")
    bench = spark.read.parquet(BENCH)
    one = rows_of(D.with_leaks(docs, bench))
    many = rows_of(D.with_leaks(docs, bench, block_chars=1500))
    key = lambda rows: [(r["doc_id"], sorted(map(str, r["leaks"]))) for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert key(one) == key(many)


def test_edges(spark):
    docs = edge_docs(spark, "leaks")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "lazy dog"), (3, "one")], "item_id long, text string")
    out = rows_of(D.with_leaks(docs, bench))
    assert len(out) == 16
    by = {r["doc_id"]: r["leaks"] for r in out}
    assert by[0] == [] and by[1] == [] and [x["item_id"] for x in by[3]] == [3, 3] and len(by[8]) == 6  # "one" is in "stone" too
    left = D.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() < 16
    assert D.with_leaks(no_docs(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.without_leaks(docs, none).count() == 16
    with pytest.raises(ValueError):
        D.with_leaks(docs, spark.createDataFrame([(1, "x" * 600_000)], "item_id long, text string"))
