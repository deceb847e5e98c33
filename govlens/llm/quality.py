"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a ratio of the text with a lowest and a highest allowed value.
``RULES`` is plain data; :func:`verdict` turns it into a single boolean expression.
No user function is run. Arrays that are needed more than once are bound as lambda
variables, so that merging projections does not evaluate them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import SPACES

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Frequent function words of the four languages of the corpus, lower case.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "as", "was", "at", "by",
              "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "auf", "für", "nicht", "ein", "eine",
              "le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "qui", "dans", "pour", "est",
              "el", "los", "las", "y", "en", "se", "por", "con", "del", "su", "no", "al", "es"]


@dataclass(frozen=True)
class Rule:
    """``top`` / ``bottom`` (measures; no bottom: ``top`` itself) must lie within
    [lowest, highest] in texts of at least ``from_words`` words; a bound that is None
    does not bind."""
    name: str
    top: str
    bottom: str | None = None
    lowest: float | None = None
    highest: float | None = None
    from_words: int = 0


RULES = [
    Rule("length", "n_words", lowest=10),
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", highest=0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", lowest=0.02, from_words=50),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", highest=0.5),
]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACES)) > 0)


def window_hashes(w: Column, k: int) -> Column:
    """A hash of each run of ``k`` consecutive words; none when there are fewer."""
    return F.when(F.size(w) >= k, F.transform(
        F.slice(w, 1, F.size(w) - (k - 1)),
        lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(h: Column, k: int) -> Column:
    """Number of words in windows whose hash occurs twice or more: the windows sorted by
    (hash, place), those with an equal neighbour kept, their places sorted, and each
    adding the words up to the next one. O(n log n) in the number of windows."""
    def repeated(t: Column) -> Column:
        return F.transform(F.filter(t, lambda x, i: F.coalesce(x["h"] == F.get(t, i - 1)["h"], F.lit(False))
                                    | F.coalesce(x["h"] == F.get(t, i + 1)["h"], F.lit(False))), lambda x: x["i"])

    def total(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(
            F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x)

    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return _let(placed, lambda t: _let(F.array_sort(repeated(t)), total))


def repeat_words(w: Column, k: int = WINDOW) -> Column:
    """Words in k-word windows found twice or more. Most texts have no such window, which
    one pass over a hash set tells; only the others are sorted."""
    return _let(window_hashes(w, k), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), _covered(h, k)).otherwise(F.lit(0)))


def verdict(rules: list[Rule], of) -> Column:
    """True if every rule holds; ``of`` gives a measure's column. A rule without a value
    (no words, no lines) does not reject."""
    checks = F.lit(True)
    for r in rules:
        value = F.try_divide(of(r.top), of(r.bottom)) if r.bottom else of(r.top).cast("double")
        for holds in ([value >= r.lowest] if r.lowest is not None else []) + (
                [value <= r.highest] if r.highest is not None else []):
            checks = checks & (F.coalesce(holds, F.lit(True)) | (of("n_words") < r.from_words))
    return checks


def measures(text: Column) -> Column:
    """All counts of a text as one struct."""
    stop = F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)])

    def of(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(without(text, SPACES)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(w, lambda x: F.array_contains(stop, F.lower(x)))).cast("long").alias("n_stop_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"))

    return _let(words(text), lambda w: _let(lines_with_words(text), lambda lines: of(w, lines)))


def quality(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with struct column ``quality``: the counts, base_failed and kept.

    base_failed: fewer than 10 words, or over 20 % of the words repeat in 5-word windows.
    kept: not base_failed and within every rule. Null and empty texts have no word: not
    kept. Repeated rows are judged one by one, all columns stay (a column named
    ``quality`` is replaced), an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    inner = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"], measures(text).alias("quality"))

    def of(name: str) -> Column:
        return F.col(f"quality.{name}")

    base = (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEAT_PERCENT * of("n_words"))
    return inner.withColumn("quality", F.struct(
        F.col("quality.*"), base.alias("base_failed"),
        (~base & verdict(RULES if rules is None else rules, of)).alias("kept")))


def kept_by_quality(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return quality(docs, rules, text_col).filter("quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
