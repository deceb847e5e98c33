"""Each stage on its own input, against brute force."""

import pytest
import test_line_dedup as lines
import test_quality as quality
from edge import edge_docs, rows_of
from pyspark.sql import functions as F
from test_near_dups import brute as components

import corpus_pipeline as P
from govlens.llm import decontaminate as D
from govlens.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = written(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def test_five_stages_in_order(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(stages):
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        n, *_, repeat = quality.brute(r.text)
        if n < 10 or 100 * repeat > 20 * n:
            assert r.doc_id not in kept
    assert len(kept) > 100


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = {i: t for i, t, n in lines.brute([(r.doc_id, r.text) for r in before.collect()]) if not n or t.split()}
    got = {str(r.doc_id): r for r in after.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    want = {i for i, c in components([(r.doc_id, r.text) for r in before.collect()], 5, 80).items() if i == c}
    assert {r.doc_id for r in after.collect()} == want


def test_decontamination_stage(stages, spark):
    before, after = stages["decontamination"]
    items = [D.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in before.collect() if not any(x in D.normal(r.text) for x in items)}
    assert {r.doc_id for r in after.collect()} == want


def test_sentencepiece_stage(stages):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after = stages["sentencepiece"]
    want = {r.doc_id: library.encode(r.text) for r in before.collect()}
    assert {r.doc_id: r.ids for r in after.collect()} == want


def test_edges_pass_all_stages(spark, tmp_path):
    docs = edge_docs(spark, "n_chars").withColumn("lang", F.col("doc_id").cast("string"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in P.STAGES:
        empty = written(stage(spark, docs.limit(0), str(tmp_path)), "empty")
        assert empty.count() == 0
        after = written(stage(spark, docs, str(tmp_path)), "edge")
    assert rows_of(after)


def test_run_is_registered(spark):
    import __spark_entry__ as E

    assert E.queries()["pipeline"] is P.run
    assert P.run(spark, SF).count() > 100
