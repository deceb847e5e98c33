"""Governance gaps, long-form check results, gates to the next level, checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlens.functions.labels import gap_severity
from govlens.functions.rubric import Rubric, gate_expression, passed, production_rubric
from govlens.operators.rollups import domain_column
from govlens.operators.scoring import check

# Gap reasons in output order, keyed by check name.
GAP_REASONS = [
    ("column_description_present", "Missing column description"),
    ("business_term_linked", "Missing business term"),
    ("security_classification_present", "Missing or invalid security classification"),
    ("data_steward_assigned", "Missing data steward"),
    ("domain_tag_present", "Missing domain tag"),
    ("sensitivity_flags_set", "PII or CDE flag is null"),
    ("certification_level_populated", "Missing or invalid certification level"),
    ("schema_assignment_valid", "Invalid schema assignment"),
    ("invalid_record_ratio_within_threshold", "Data quality failed: invalid record ratio exceeds 5%"),
]
GAP_SEPARATOR = ", "

GAP_COLUMNS = ["database_name", "schema_name", "table_name", "column_id", "column_name",
               "data_steward", "security_classification", "achieved_cert_level",
               "completeness_pct", "dq_invalid_pct", "gap_reason"]


def gap_reason_column():
    return F.concat_ws(GAP_SEPARATOR, *[F.when(~check(name), F.lit(text))
                                       for name, text in GAP_REASONS])


def governance_gaps(silver: DataFrame) -> DataFrame:
    """Assets failing any of the nine governance checks, with the reason list."""
    return (silver.withColumn("gap_reason", gap_reason_column())
            .filter(F.col("gap_reason") != "")
            .select(*GAP_COLUMNS))


def gap_reasons(gaps: DataFrame) -> DataFrame:
    """One row per (asset, reason) with the reason's severity."""
    return (gaps.select("column_id", "table_name", "column_name", "data_steward",
                        F.explode(F.split("gap_reason", GAP_SEPARATOR)).alias("reason"))
            .withColumn("severity", gap_severity("reason")))


def _domain_reasons(silver: DataFrame) -> DataFrame:
    return (silver.withColumns({"domain": domain_column(), "gap_reason": gap_reason_column()})
            .filter(F.col("gap_reason") != "")
            .select("domain", "data_steward",
                    F.explode(F.split("gap_reason", GAP_SEPARATOR)).alias("reason")))


def top_gaps_by_domain(silver: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent gap reasons per domain (ties by reason text).

    Counting is a partial aggregation; the window ranks the aggregated
    (domain, reason) rows, at most nine per domain.
    """
    counts = _domain_reasons(silver).groupBy("domain", "reason").agg(F.count("*").alias("gap_count"))
    w = Window.partitionBy("domain").orderBy(F.col("gap_count").desc(), F.col("reason").asc())
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("severity", gap_severity("reason")))


def gaps_by_steward(silver: DataFrame) -> DataFrame:
    """Gap reasons per steward ('Unassigned' when no steward)."""
    return (_domain_reasons(silver)
            .withColumn("data_steward", F.coalesce("data_steward", F.lit("Unassigned")))
            .groupBy("data_steward", "reason").agg(F.count("*").alias("gap_count"))
            .withColumn("severity", gap_severity("reason")))


def check_results(silver: DataFrame, rubric: Rubric | None = None) -> DataFrame:
    """Long form: one row per asset x check (a generator in the same stage,
    rubric attributes inlined as literals, no join)."""
    rubric = rubric or production_rubric()

    def lit(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "\\'") + "'"

    args = []
    for c in rubric.checks:
        args += [lit(c.id), lit(c.name), lit(c.category), lit(c.severity), lit(c.fail_message),
                 f"coalesce(CAST(`{c.column}` AS BOOLEAN), false)"]
    gen = (f"stack({len(rubric.checks)}, {', '.join(args)}) AS "
           "(check_id, check_name, category, severity, fail_message, passed)")
    out = silver.selectExpr("column_id", "table_id", "table_name", "column_name", gen)
    return out.withColumn("fail_message", F.when(~F.col("passed"), F.col("fail_message")))


def gates_to_next_level(silver: DataFrame, rubric: Rubric | None = None) -> DataFrame:
    """Next level an asset has not reached and the gate checks it still fails."""
    rubric = rubric or production_rubric()
    by_id = rubric.by_id()
    ascending = list(reversed(rubric.levels_by_rank()))
    nxt = None
    missing = None
    for lv in ascending:
        fails = ~gate_expression(rubric, lv)
        failed_ids = F.concat_ws(", ", *[F.when(~passed(by_id[c].column), F.lit(c))
                                         for c in lv.gate_checks])
        nxt = F.when(fails, F.lit(lv.name)) if nxt is None else nxt.when(fails, F.lit(lv.name))
        missing = F.when(fails, failed_ids) if missing is None else missing.when(fails, failed_ids)
    return silver.select(
        "column_id", "table_id", "table_name", "column_name", "achieved_cert_level",
        nxt.alias("next_level"), F.coalesce(missing, F.lit("")).alias("missing_checks"))


# The table certification checklist items, in order.
def checklist_items():
    return [
        ("table_name_present", F.col("table_name").isNotNull()),
        ("table_description_present", F.col("table_desc").isNotNull()),
        ("column_description_present", check("column_description_present")),
        ("data_steward_assigned", check("data_steward_assigned")),
        ("business_term_linked", check("business_term_linked")),
        ("security_classification_present", check("security_classification_present")),
        ("pii_flag_set", F.col("pii_flag").isNotNull()),
        ("certification_level_populated", check("certification_level_populated")),
        ("domain_tag_present", check("domain_tag_present")),
    ("data_quality_within_threshold", F.coalesce(F.col("dq_invalid_pct") <= 5, F.lit(False))),
    ]


def cert_checklist(silver: DataFrame) -> DataFrame:
    """Per table: each checklist item passes only if every column passes it."""
    keys = ["system_name", "database_name", "schema_name", "table_id", "table_name"]
    items = checklist_items()
    agg = silver.groupBy(*keys).agg(*[F.bool_and(e).alias(n) for n, e in items])
    failed = F.concat_ws(", ", *[F.when(~F.col(n), F.lit(n)) for n, _ in items])
    n_failed = sum(F.when(~F.col(n), 1).otherwise(0) for n, _ in items)
    return agg.withColumns({"failed_items": n_failed, "what_to_fix": failed})


def unclassified_pii(silver: DataFrame) -> DataFrame:
    """Tables with PII columns that lack a valid security classification."""
    bad = (F.col("pii_flag") == True) & ~check("security_classification_present")  # noqa: E712
    return (silver.filter(bad)
            .groupBy("system_name", "database_name", "schema_name", "table_id", "table_name")
            .agg(F.count("*").alias("unclassified_pii_columns")))
