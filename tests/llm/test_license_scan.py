import random
import re

from edge import edge_docs, no_docs, rows_of

from govlens.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute_base(text):
    w, out = brute_words(text), []
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        out += [(label, i) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return sorted(out)


def check(df):
    rows = sorted(df.select("doc_id", "text").collect(), key=str)
    got = sorted(rows_of(L.scan_licenses(df)), key=lambda r: (str(r["doc_id"]), r["n_words"], str(r["exact"])))
    want = sorted(((r.doc_id, len(brute_words(r.text)), brute_base(r.text)) for r in rows),
                  key=lambda r: (str(r[0]), r[1], str(r[2])))
    assert [(r["doc_id"], r["n_words"], sorted((m["label"], m["first_word"]) for m in r["exact"])) for r in got] == want
    return got


def test_documents(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(r["fuzzy"] for r in got)


def test_edges(spark):
    check(edge_docs(spark, "exact"))
    check(spark.createDataFrame([(1, "CC BY cc-by CC, by; All Rights\nReserved General Public Licenses ccÉby"),
                                 (2, "cc by cc by general  public license all rights reserved")], "doc_id long, text string"))
    assert L.scan_licenses(no_docs(spark)).count() == 0


def test_edited_notices_are_found_with_span_and_edits():
    scanner = L.Scanner(L.PHRASES, L.NOTICES, L.CHARS_PER_EDIT)
    rnd = random.Random(3)
    for label, notice in L.NOTICES:
        for _ in range(25):
            s, k = list(notice), rnd.randrange(len(notice) // L.CHARS_PER_EDIT + 1)
            for p in rnd.sample([i for i, c in enumerate(notice) if c != " "], k):
                s[p] = "q"
            text = "zz yy " + "".join(s) + " xx ww"
            found = [m for m in scanner.fuzzy(" ".join(text.split())) if m.label == label]
            assert found and found[0].edits <= k and found[0].first_word == 2
            assert found[0].n_words == len(notice.split())


def test_clean_text_has_no_notice():
    scanner = L.Scanner(L.PHRASES, L.NOTICES, L.CHARS_PER_EDIT)
    for text in ("the license of the software was granted to any person", "all rights are reserved", "", "cc"):
        assert scanner.fuzzy(text) == [] and scanner.exact(text) == []
