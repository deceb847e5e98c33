"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and runs on to the river bank near the old stone mill today"

EDGE_TEXTS = [None, "", " \t\n ", "one", BASE, BASE, LONG, "\n\n", BASE + "\n" + BASE, "漢字かな交じり文 🙂 é ü",
              "a\r\nb\x0bc\x0cd", "<|endoftext|> x <|im_end|>", "x" * 5_000]


def edge_docs(spark, extra: str = "n_tokens"):
    """Edge rows with null and repeated ids, and a column whose name clashes with results."""
    rows = [(i, t, f"c{i}") for i, t in enumerate(EDGE_TEXTS)]
    rows += [(4, BASE, "c4"), (None, BASE, None), (None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra} string")


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept string")


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
