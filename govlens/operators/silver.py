"""Silver layer: typed, cleaned, key-rebuilt, deduplicated, rubric-scored rows.

Every step is one projection or one aggregation over the whole input; the only
shuffle is the keep-best dedup, which is a partial (map-side combined)
aggregation, so an asset with millions of snapshots never lands in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from govlens.functions.rubric import (
    Rubric, check_expression, level_expression, production_rubric, require_fields,
)
from govlens.functions.text import KEY_SEPARATOR, blank_to_null, norm, surrogate_id

BOOLEAN_COLUMNS = ("pii_flag", "critical_data_element_flag")
COUNT_COLUMNS = ("total_record_count", "invalid_record_count")

# Value synonyms and the columns title-cased by standardisation.
DEFAULT_SYNONYMS = {"security_classification": {"Conf": "Confidential"}}
INITCAP_COLUMNS = ("certification_level",)

# Name hierarchy for rebuilt ids (root first).
KEY_LEVELS = {
    "database_id": ("system_name", "database_name"),
    "schema_id": ("system_name", "database_name", "schema_name"),
    "table_id": ("system_name", "database_name", "schema_name", "table_name"),
    "column_id": ("system_name", "database_name", "schema_name", "table_name", "column_name"),
}

# Governance attributes counted to pick the most complete snapshot.
GOVERNANCE_FIELDS = ("column_desc", "term_name", "data_steward", "security_classification",
                     "pii_flag", "critical_data_element_flag", "tag_value")

# Hard expectations; failing rows are dropped from silver.
EXPECTATIONS = {
    "valid_column_id": "column_id IS NOT NULL",
    "valid_column_name": "column_name IS NOT NULL",
    "valid_table_id": "table_id IS NOT NULL",
}


def to_boolean(col: str | Column) -> Column:
    """ANSI-safe text -> boolean (t/true/y/yes/1 and opposites; else NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("boolean")


def to_count(col: str | Column) -> Column:
    """Float-formatted text -> BIGINT (truncating); unparsable or out of range -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("double").try_cast("bigint")


def cast_types(df: DataFrame, booleans=BOOLEAN_COLUMNS, counts=COUNT_COLUMNS) -> DataFrame:
    casts = {c: to_boolean(c) for c in booleans if c in df.columns}
    casts.update({c: to_count(c) for c in counts if c in df.columns})
    return df.withColumns(casts)


def normalize_strings(df: DataFrame) -> DataFrame:
    """Strip whitespace of every string column; empty -> NULL (one projection)."""
    return df.withColumns({c: blank_to_null(c) for c, t in df.dtypes if t == "string"})


def standardize(df: DataFrame, synonyms=None, initcap_columns=INITCAP_COLUMNS) -> DataFrame:
    """Replace value synonyms and title-case the declared level."""
    synonyms = DEFAULT_SYNONYMS if synonyms is None else synonyms
    out = {}
    for col, mapping in synonyms.items():
        e = F.col(col)
        expr = None
        for src, dst in mapping.items():
            expr = F.when(e == src, dst) if expr is None else expr.when(e == src, dst)
        if expr is not None:
            out[col] = expr.otherwise(e)
    for col in initcap_columns:
        out[col] = F.initcap(F.col(col))
    return df.withColumns(out)


def rebuild_keys(df: DataFrame, levels=None, stripped: bool = False) -> DataFrame:
    """Keep source ids as ``source_*_id``; rebuild ids from the normalised name path.

    Each name part is normalised once (a helper column) and shared by the four
    path keys, instead of once per key."""
    levels = KEY_LEVELS if levels is None else levels
    kept = df.withColumnsRenamed({k: f"source_{k}" for k in levels if k in df.columns})
    names = list(dict.fromkeys(p for path in levels.values() for p in path))
    helper = {p: f"__norm_{p}" for p in names}
    # concat (unlike concat_ws) is null as soon as one part is, which makes the id null
    ids = {k: surrogate_id(F.concat(*interleaved([F.col(helper[p]) for p in path], F.lit(KEY_SEPARATOR))))
           for k, path in levels.items()}
    # names that are stripped already need only be lower-cased
    return kept.withColumns({h: F.lower(p) if stripped else norm(p) for p, h in helper.items()}).withColumns(ids).drop(*helper.values())


def interleaved(parts: list[Column], separator: Column) -> list[Column]:
    return [c for p in parts for c in (separator, p)][1:]


def _rule(cond: str) -> Column:
    return F.coalesce(F.expr(cond), F.lit(False))


def expectations_met(rules=EXPECTATIONS) -> Column:
    return reduce(lambda a, b: a & b, [_rule(c) for c in rules.values()])


def expectation_counts(df: DataFrame, rules=EXPECTATIONS) -> DataFrame:
    """One row per expectation: rows passing and failing it (single pass)."""
    aggs = []
    for name, cond in rules.items():
        aggs += [F.count_if(_rule(cond)).alias(f"{name}__passed"),
                 F.count_if(~_rule(cond)).alias(f"{name}__failed")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}__passed`, `{n}__failed`" for n in rules)
    return wide.selectExpr(f"stack({len(rules)}, {stack}) AS (expectation, passed_rows, failed_rows)")


def _rule_before_dedup(cond: str) -> Column:
    """A rule on prepared rows: ids are not built yet, so a test of one is a test of its path."""
    for key in KEY_LEVELS:
        if cond.replace(" ", "") == f"{key}ISNOTNULL":
            return path_present(key)
    return _rule(cond)


def observed_expectations(prepared: DataFrame, observation: Observation, rules=EXPECTATIONS) -> DataFrame:
    """``prepared``, with the rows that pass and fail each expectation counted by whatever job reads
    it (see :func:`expectation_report`)."""
    metrics = []
    for name, cond in rules.items():
        met = _rule_before_dedup(cond)
        metrics += [F.count_if(met).alias(f"{name}__passed"), F.count_if(~met).alias(f"{name}__failed")]
    return prepared.observe(observation, *metrics)


def expectation_report(spark: SparkSession, observation: Observation, rules=EXPECTATIONS) -> DataFrame:
    """The counts of a finished write, as :func:`expectation_counts` gives them."""
    got = observation.get
    return spark.createDataFrame([(n, got[f"{n}__passed"], got[f"{n}__failed"]) for n in rules],
                                 "expectation string, passed_rows long, failed_rows long")


def completeness_count(fields=GOVERNANCE_FIELDS) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in fields])


def best_first(cols: list[str], key: str, fields=GOVERNANCE_FIELDS, tiebreak=("source_column_id",)) -> Column:
    """A row of ``cols`` as a struct whose smallest value is the best snapshot of ``key``."""
    rest = [c for c in cols if c != key and c not in tiebreak]
    return F.struct((-completeness_count(fields)).alias("__neg_completeness"),
                    *[F.col(c) for c in tiebreak], *[F.col(c) for c in rest])


# Types with a text that orders like the values.
TEXT_TYPES = ("string", "boolean", "bigint", "timestamp")
_DIGITS = ("0123456789", "9876543210")


def ordered_text(column: str, dtype: str) -> Column:
    """The value as a text that orders like it; null stays null. Whole numbers are a sign (0 or 1), a
    letter for the number of digits and the digits; of negative ones letter and digits run backwards."""
    c = F.col(column)
    if dtype == "string":
        return c
    if dtype == "boolean":
        return c.cast("string")
    number = (F.unix_micros(c) if dtype == "timestamp" else c).cast("string")
    digits = F.ltrim(number, F.lit("-"))
    return F.when(number.startswith("-"), F.concat(
        F.lit("0"), F.char(F.lit(90) - F.length(digits)), F.translate(digits, *_DIGITS))).otherwise(
        F.concat(F.lit("1"), F.char(F.lit(64) + F.length(digits)), digits))


def from_ordered_text(text: Column, dtype: str) -> Column:
    """The value of :func:`ordered_text`."""
    if dtype == "string":
        return text
    if dtype == "boolean":
        return text.cast("boolean")
    digits = F.substr(text, F.lit(3))
    number = F.when(text.startswith("0"), F.concat(F.lit("-"), F.translate(digits, *_DIGITS))).otherwise(digits).cast("bigint")
    return F.timestamp_micros(number) if dtype == "timestamp" else number


def text_runs(dtypes: list[tuple[str, str]]) -> list[list[str]]:
    """The columns in order, with neighbours of ``TEXT_TYPES`` in one list and any other in its own."""
    runs: list[list[str]] = []
    text = False
    for c, t in dtypes:
        if text and t in TEXT_TYPES:
            runs[-1].append(c)
        else:
            runs.append([c])
        text = t in TEXT_TYPES
    return runs


def packed(columns: list[str | Column]) -> Column:
    """The text columns as one text, which orders like the columns one after another, nulls first.

    A value is marked by \\x01 and ended by \\x00, a null is empty; both characters are escaped in values."""
    return F.array_join(F.transform(F.array(*columns), lambda x: F.when(x.isNull(), "").otherwise(
        F.concat(F.lit("\x01"), F.replace(F.replace(x, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))))), "\x00")


def unpacked(text: str) -> Column:
    """The values of :func:`packed`, as an array."""
    return F.transform(F.split(text, "\\x00"), lambda x: F.when(x != "", F.replace(F.replace(
        F.substr(x, F.lit(2)), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))))


def key_path(path, stripped: bool = False) -> Column:
    """The text whose hash is the id of ``path``: its normalised names; null as soon as one is missing."""
    names = [F.lower(p) if stripped else norm(p) for p in path]
    return F.concat(*interleaved(names, F.lit(KEY_SEPARATOR)))


def dedup_best(df: DataFrame, key: str = "column_id", fields=GOVERNANCE_FIELDS,
               tiebreak=("source_column_id",), levels=None) -> DataFrame:
    """One row per ``key``: most complete snapshot, then smallest tiebreak
    (NULL first), then the remaining columns in order (a total order, so the
    survivor never depends on partitioning).

    Expressed as ``min(struct(...))`` per key: a partial aggregation, combined
    map-side before the shuffle, so hot keys are reduced before they move.

    ``levels`` names the ids of ``df``, ``key`` among them, that :func:`rebuild_keys` made of its (stripped)
    names. Hashes barely compress, so they are not shuffled: rows are grouped by the text that
    the key is a hash of, and the survivors' ids are made again. Completeness, tiebreak and the other
    columns move as one text (see :func:`packed`), which compresses better and sorts the same; a column
    of a type without such a text moves beside it.
    """
    cols = df.columns
    if levels is not None:
        types = dict(df.dtypes)
        ordered = [*tiebreak, *[c for c in cols if c not in levels and c not in tiebreak]]
        runs = text_runs([("__rank", "string"), *[(c, types[c]) for c in ordered]])
        width = len(str(len(fields)))
        ranked = df.withColumn("__rank", F.lpad((F.lit(len(fields)) - completeness_count(fields)).cast("string"), width, "0"))
        types["__rank"] = "string"
        moved = [(packed([ordered_text(c, types[c]) for c in run]) if len(run) > 1 else F.col(run[0])).alias(f"__run{i}")
                 for i, run in enumerate(runs)]
        best = ranked.groupBy(key_path(levels[key], stripped=True).alias("__path")).agg(
            F.min(F.struct(*moved) if len(runs) > 1 else moved[0]).alias("__best"))
        best = best.select("__best.*" if len(runs) > 1 else F.col("__best").alias("__run0")).withColumns(
            {f"__run{i}": unpacked(f"__run{i}") for i, run in enumerate(runs) if len(run) > 1})
        rows = best.select(*[(F.col(f"__run{i}") if len(run) == 1 else from_ordered_text(F.get(f"__run{i}", F.lit(j)), types[c])).alias(c)
                             for i, run in enumerate(runs) for j, c in enumerate(run) if c != "__rank"])
        return rebuild_keys(rows, {k: path for k, path in levels.items() if k in cols}, stripped=True).select(*cols)
    best = df.groupBy(key).agg(F.min(best_first(cols, key, fields, tiebreak)).alias("__best"))
    return best.select(*[F.col(key) if c == key else F.col(f"__best.{c}").alias(c) for c in cols])


def evaluate_rubric(df: DataFrame, rubric: Rubric) -> DataFrame:
    """One boolean ``check_<name>`` per check plus the informational scores."""
    require_fields(df, rubric)
    checks = {c.column: check_expression(c) for c in rubric.checks}
    out = df.withColumns(checks)
    total = len(rubric.checks)
    passed = reduce(lambda a, b: a + b,
                    [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in checks])
    out = out.withColumns({"checks_passed": passed, "checks_total": F.lit(total)})
    return out.withColumns({
        "completeness_pct": F.col("checks_passed") / F.lit(total) * 100,
        "dq_invalid_pct": F.when(
            F.col("total_record_count") > 0,
            F.col("invalid_record_count") / F.col("total_record_count") * 100),
    })


def certify(df: DataFrame, rubric: Rubric) -> DataFrame:
    """Gated level: the highest level whose gate checks all pass, else 'None'."""
    return df.withColumn("achieved_cert_level", level_expression(rubric))


def prepare(bronze: DataFrame, synonyms=None) -> DataFrame:
    """Typed, cleaned, standardised rows with rebuilt ids (no filter, no dedup)."""
    return rebuild_keys(standardize(normalize_strings(cast_types(bronze)), synonyms), stripped=True)


def prepare_for_dedup(bronze: DataFrame, synonyms=None, stripped: bool = False) -> DataFrame:
    """As :func:`prepare`, with the dedup key as the only new id: the other ids are
    functions of the same names, so they are built on the survivors. ``stripped`` says that
    the bronze strings are stripped and never empty, as ``to_bronze`` leaves them."""
    typed = cast_types(bronze)
    clean = standardize(typed if stripped else normalize_strings(typed), synonyms)
    others = {k: f"source_{k}" for k in KEY_LEVELS if k != "column_id" and k in clean.columns}
    return rebuild_keys(clean.withColumnsRenamed(others), {"column_id": KEY_LEVELS["column_id"]}, stripped=True)


def with_all_keys(df: DataFrame) -> DataFrame:
    """Adds the ids that :func:`prepare_for_dedup` leaves out, in the order of :func:`prepare`."""
    others = {k: path for k, path in KEY_LEVELS.items() if k != "column_id"}
    columns = [c for c in df.columns if c != "column_id"]
    return rebuild_keys(df, others, stripped=True).select(*columns, *others, "column_id")


def path_present(key: str = "column_id", levels=None) -> Column:
    """``<key> IS NOT NULL`` stated on its inputs: every name on the path is present."""
    levels = KEY_LEVELS if levels is None else levels
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in levels[key]])


def _output_rules(rules, key: str) -> Column:
    """Expectations for rows after the dedup on ``key``.

    A test of the grouping key itself would be pushed below the aggregate and
    through every cleaning projection (each substitution copies the key
    expression into a scan-side Filter); the equivalent test on the path names,
    which are aggregate outputs, stays where it is.
    """
    others = [c for c in rules.values() if c.replace(" ", "") != f"{key}ISNOTNULL"]
    cond = path_present(key)
    for c in others:
        cond = cond & _rule(c)
    return cond


def expected_rows(prepared: DataFrame, rules=EXPECTATIONS, levels=None) -> DataFrame:
    """Keep-best rows that pass the hard expectations (silver before the rubric); ``levels`` as in
    :func:`dedup_best`."""
    return dedup_best(prepared, levels=levels).filter(_output_rules(rules, "column_id"))


def build_silver(bronze: DataFrame, rubric: Rubric | None = None, synonyms=None,
                 rules=EXPECTATIONS, stripped: bool = False, observation: Observation | None = None) -> DataFrame:
    """Bronze rows -> silver (one row per system.db.schema.table.column).

    As in the source, the hard expectations apply to the deduplicated output.
    Rows with a NULL key form one group, but the partial aggregation reduces it
    to one row per input partition before the shuffle, so it is never hot. With an
    ``observation`` the job that writes silver also counts the expectations (before the dedup).
    """
    rubric = rubric or production_rubric()
    prepared = prepare_for_dedup(bronze, synonyms, stripped)
    if observation is not None:
        prepared = observed_expectations(prepared, observation, rules)
    best = with_all_keys(dedup_best(prepared, levels={"column_id": KEY_LEVELS["column_id"]}))
    return certify(evaluate_rubric(best.filter(_output_rules(rules, "column_id")), rubric), rubric)


def silver_from_prepared(prepared: DataFrame, rubric: Rubric | None = None,
                         rules=EXPECTATIONS) -> DataFrame:
    """Keep-best dedup, expectations and rubric over prepared rows (or over
    earlier keep-best outputs: the dedup is associative, so re-deduplicating
    partial results gives the same survivors)."""
    rubric = rubric or production_rubric()
    return certify(evaluate_rubric(expected_rows(prepared, rules), rubric), rubric)


def quarantine(bronze: DataFrame, synonyms=None, rules=EXPECTATIONS) -> DataFrame:
    """Rows silver drops (before the dedup), with the expectations they violate.

    Every default rule fails exactly when a name on the column path is missing,
    so the row filter tests the names; the reasons are computed after it."""
    typed = prepare(bronze, synonyms)
    if rules is EXPECTATIONS:
        bad = typed.filter(~path_present("column_id"))
    else:
        bad = typed.filter(~expectations_met(rules))
    reasons = F.concat_ws(", ", *[F.when(~_rule(c), F.lit(n)) for n, c in rules.items()])
    return bad.withColumn("_failed_expectations", reasons)
