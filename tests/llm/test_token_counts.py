import public_tokenizers
import regex
from edge import edge_docs, no_docs, rows_of
from tokenizers import Tokenizer

from govlens.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(df):
    rows = sorted(df.collect(), key=str)
    n = expected([r.text for r in rows])
    want = sorted((str(r.doc_id), len((r.text or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(T.count_tokens(df, PATH)))
    assert got == want


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_edges(spark):
    check(edge_docs(spark))
    assert T.count_tokens(no_docs(spark), PATH).count() == 0


def test_small_table_and_cache(spark):
    docs = edge_docs(spark)
    a = T.count_tokens(docs, PATH, table_size=1, cache_size=2)
    assert sorted(map(str, rows_of(a))) == sorted(map(str, rows_of(T.count_tokens(docs, PATH))))


def test_classes_agree_with_the_library():
    """Every code point that takes the fast path is cut as the library cuts it."""
    library, find = Tokenizer.from_file(PATH).pre_tokenizer, regex.compile(T.PRE_TOKEN).findall
    agreed = regex.compile(T.AGREED).fullmatch
    tried = 0
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and agreed(chr(c)):
            tried += 1
            x = chr(c)
            s = f"a{x}1{x} {x}!{x}{x}\n{x} "
            assert len(library.pre_tokenize_str(s)) == len(find(s)), hex(c)
    assert tried > 30_000
