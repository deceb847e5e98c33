import re

from edge import edge_docs, no_docs, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from govlens.llm import quality as Q


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def measured(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: (r.quality.n_words, r.quality.word_chars, r.quality.n_symbols, r.quality.n_dup_lines,
                       r.quality.n_repeat_words) for r in Q.quality(df).collect()}


TEXTS = st.text(alphabet=st.sampled_from(list("ab #*é漢 \n\t\x0b ")), max_size=80)


@settings(max_examples=8, deadline=None)
@given(st.lists(TEXTS, min_size=40, max_size=60))
def test_counts_against_brute_force(spark, texts):
    assert measured(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert list(measured(spark, [r.text for r in rows]).values()) == [brute(r.text) for r in rows]


def test_edges(spark):
    docs = edge_docs(spark, "quality")
    out = Q.quality(docs)
    assert out.columns == ["doc_id", "text", "quality"] and out.count() == 16
    for r in rows_of(out):
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute(r["text"])
        assert q["base_failed"] == (q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"])
        assert not (q["base_failed"] and q["kept"])
    assert Q.kept_by_quality(docs).columns == docs.columns
    assert Q.quality(no_docs(spark)).count() == 0


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj # # #"), (2, "aa bb cc dd ee ff gg hh ii jj kk")],
                                 "doc_id long, text string")
    kept = lambda rules: {r.doc_id for r in Q.kept_by_quality(docs, rules).collect()}
    assert kept([]) == {1, 2}
    assert kept([Q.Rule("s", "n_symbols", "n_words", highest=0.1)]) == {2}
    assert kept([Q.Rule("s", "n_symbols", lowest=1)]) == {1}
    assert kept([Q.Rule("s", "n_symbols", "n_words", highest=0.1, from_words=20)]) == {1, 2}


def test_one_projection_without_user_functions(spark):
    plan = Q.quality(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "good")
    r = Q.quality(docs).join(labels, "doc_id").filter("good = 1 and not quality.base_failed").selectExpr(
        "count(*)", "count_if(quality.kept)").first()
    assert r[0] == r[1] > 300
