"""Semantic layer over the gold tables: fields, filters, measures, joins and
the trusted questions, all as DataFrame functions picked by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions.exact import finish, half_up_div
from govlens.functions.exact_sum import exact_avg
from govlens.functions.labels import asset_location, health_band, maturity_tier
from govlens.operators.gaps import gap_reason_column
from govlens.operators.rollups import domain_column
from govlens.operators.scoring import PROFILE_COLUMNS
from govlens.operators.access import CHECK_COLUMNS, access_for, access_pairs

Gold = dict  # name -> DataFrame (see plans.pipeline.Gold)

# Derived fields: usable as grouping keys of measures on tables that have their inputs.
FIELDS: dict[str, Callable[[], Column]] = {
    "domain": domain_column,
    "asset_location": asset_location,
    "health_band": health_band,
    "maturity_tier": maturity_tier,
}

# name -> (gold table, predicate)
FILTERS: dict[str, tuple[str, Callable[[], Column]]] = {
    "pii": ("profile", lambda: F.col("pii_flag") == True),  # noqa: E712
    "cde": ("profile", lambda: F.col("critical_data_element_flag") == True),  # noqa: E712
    "dq_fail": ("profile", lambda: F.col("dq_invalid_pct") > 5),
    "uncertified": ("profile", lambda: F.col("achieved_cert_level") == "None"),
    "no_steward": ("profile", lambda: F.col("data_steward").isNull()),
    "outliers": ("structural_consistency", lambda: F.col("is_outlier") == True),  # noqa: E712
    "restricted": ("asset_access_policy", lambda: F.col("asset_region") != "UNRESTRICTED"),
}


def _count_when(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _avg_cents(col: str) -> Column:
    """Average of a 2-decimal column from its integer sum of cents (independent
    of summation order)."""
    c = F.col(col)
    return F.sum(F.round(c * 100).cast("bigint")) / F.count(c) / 100


def _avg_completeness() -> Column:
    """Average completeness from the integer counts of checks passed and made, so it holds
    for a rubric of any size and does not depend on summation order."""
    return F.try_divide(F.sum("checks_passed").cast("bigint") * 100, F.sum("checks_total").cast("bigint"))


# name -> (gold table, aggregate)
MEASURES: dict[str, tuple[str, Callable[[], Column]]] = {
    "governance_score": ("table_governance", lambda: _avg_cents("table_governance_score")),
    "completeness": ("scores_pre", lambda: _avg_completeness()),
    "quality": ("profile", lambda: exact_avg(100 - F.col("dq_invalid_pct"))),
    "gap_count": ("governance_gaps", lambda: F.count("column_id")),
    "registered": ("profile", lambda: _count_when(F.col("achieved_cert_level") == "Registered")),
    "documented": ("profile", lambda: _count_when(F.col("achieved_cert_level") == "Documented")),
    "certified": ("profile", lambda: _count_when(F.col("achieved_cert_level") == "Certified")),
    "unclassified": ("profile", lambda: _count_when(F.col("achieved_cert_level") == "None")),
    "pii": ("profile", lambda: _count_when(F.col("pii_flag") == True)),  # noqa: E712
    "cde": ("profile", lambda: _count_when(F.col("critical_data_element_flag") == True)),  # noqa: E712
    "avg_invalid": ("profile", lambda: exact_avg("dq_invalid_pct")),
    "tables": ("table_governance", lambda: F.count_distinct("table_id")),
    "schemas": ("table_structure", lambda: F.count_distinct("schema_id")),
    "databases": ("table_structure", lambda: F.count_distinct("database_id")),
    "structural_rate": ("structural_consistency",
                        lambda: F.avg(F.when(F.col("is_outlier") == False, 100).otherwise(0))),  # noqa: E712
}


def apply_filter(gold: Gold, name: str) -> DataFrame:
    table, pred = FILTERS[name]
    return gold[table].filter(pred())


# Tables of one row per column that have all columns of the profile.
COLUMN_GRAIN = ("profile", "scores_pre")


def measure(gold: Gold, name: str, *filters: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The measure, scoped by filters on the same table; one row, or one per value of ``by``.

    ``by`` names columns of the measure's table or derived fields (``FIELDS``). Measures on
    the profile group by any column of the silver table (e.g. ``tag_value``, ``table_id``)."""
    table, agg = MEASURES[name]
    if by and table == "profile":
        table = "scores_pre"
    df = gold[table]
    for f in filters:
        ftable, pred = FILTERS[f]
        if ftable != table and not {ftable, table} <= set(COLUMN_GRAIN):
            raise ValueError(f"filter {f} applies to {ftable}, measure {name} to {table}")
        df = df.filter(pred())
    value = agg().alias(f"measure_{name}")
    if not by:
        return df.agg(value)
    unknown = [b for b in by if b not in FIELDS and b not in df.columns]
    if unknown:
        raise ValueError(f"measure {name}: {table} has no field {', '.join(unknown)}")
    return df.groupBy(*[FIELDS[b]().alias(b) if b in FIELDS else F.col(b) for b in by]).agg(value)


# ---------------------------------------------------------------- joins

PATH = ["system_name", "database_name", "schema_name", "table_name"]


def join_profile_governance(gold: Gold) -> DataFrame:
    """Column rows with their table's governance scores: one row per column.

    Joined null-safe on all keys that table_governance is grouped by (path, table id,
    description and steward), so neither a name shared by several systems nor several
    descriptions of one table multiply rows."""
    p, g = gold["scores_pre"].select(*PROFILE_COLUMNS, "table_id", "table_desc"), gold["table_governance"]
    keys = PATH + ["data_steward", "table_id", "table_desc"]
    g = g.select(*[F.col(k).alias(f"g_{k}") for k in keys], "column_count", "table_governance_score",
                 "avg_documentation_score", "avg_quality_score", "pii_column_count", "critical_column_count")
    cond = None
    for k in keys:
        c = p[k].eqNullSafe(g[f"g_{k}"])
        cond = c if cond is None else cond & c
    return p.join(g, cond, "left").drop(*[f"g_{k}" for k in keys])


def join_profile_governance_declared(gold: Gold) -> DataFrame:
    """The join as the model declares it, on ``table_name`` alone: a name that several
    governance rows share pairs with each of them."""
    g = gold["table_governance"].select(
        "table_name", F.col("table_id").alias("governance_table_id"), "table_governance_score",
        "avg_documentation_score", "avg_quality_score")
    return gold["profile"].join(g, "table_name", "inner")


def join_profile_structure(gold: Gold) -> DataFrame:
    s = gold["table_structure"].select(
        "column_id", "database_id", "schema_id", "table_id", "location", "table_desc", "column_desc")
    return gold["profile"].join(s, "column_id", "inner")


def join_profile_gaps(gold: Gold) -> DataFrame:
    g = gold["governance_gaps"].select("column_id", "gap_reason")
    return gold["profile"].join(g, "column_id", "left")


def join_access_user(gold: Gold) -> DataFrame:
    """Access rows with the user's country and location, which the pairs carry along."""
    return access_pairs(gold["asset_access_policy"], gold["user_profile"],
                        user_columns=("user_country", "employee_location")).select(
        *CHECK_COLUMNS, "user_country", "employee_location")


def join_access_policy(gold: Gold) -> DataFrame:
    """Access rows with the database and schema of their policy row (one per table_id;
    table_name is not unique)."""
    return access_pairs(gold["asset_access_policy"], gold["user_profile"]).select(
        *CHECK_COLUMNS, "database_name", "schema_name")


JOINS = {
    "profile_governance": join_profile_governance,
    "profile_governance_declared": join_profile_governance_declared,
    "profile_structure": join_profile_structure,
    "profile_gaps": join_profile_gaps,
    "access_user": join_access_user,
    "access_policy": join_access_policy,
}

# ---------------------------------------------------------------- questions

TG_ORDER = ["table_id", "system_name", "database_name", "schema_name", "table_name", "table_desc",
            "data_steward"]


def _tg_ranked(gold: Gold, ascending: bool, k: int) -> DataFrame:
    score = F.col("table_governance_score")
    order = [score.asc_nulls_first() if ascending else score.desc_nulls_last()]
    order += [F.col(c).asc_nulls_first() for c in TG_ORDER]
    return gold["table_governance"].orderBy(*order).limit(k)


def q_lowest_scores(gold: Gold, k: int = 10) -> DataFrame:
    return _tg_ranked(gold, True, k).select(
        asset_location().alias("asset_location"), health_band().alias("health_band"),
        "table_name", "table_governance_score")


def q_highest_scores(gold: Gold, k: int = 10) -> DataFrame:
    return _tg_ranked(gold, False, k).select("table_name", "table_governance_score")


def q_gaps(gold: Gold) -> DataFrame:
    return gold["governance_gaps"].select("table_name", "column_name", "gap_reason")


def q_pii(gold: Gold) -> DataFrame:
    return apply_filter(gold, "pii").select("table_name", "column_name", "security_classification")


def q_cde(gold: Gold) -> DataFrame:
    return apply_filter(gold, "cde").select("table_name", "column_name")


def q_levels(gold: Gold) -> DataFrame:
    return (gold["profile"].groupBy("achieved_cert_level").agg(F.count("*").alias("asset_count"))
            .orderBy(F.col("asset_count").desc(), "achieved_cert_level"))


def q_stewards(gold: Gold) -> DataFrame:
    return (gold["profile"].filter(F.col("data_steward").isNotNull())
            .groupBy("data_steward").agg(F.count("*").alias("asset_count"))
            .orderBy(F.col("asset_count").desc(), "data_steward"))


def q_dq_issues(gold: Gold) -> DataFrame:
    return (apply_filter(gold, "dq_fail").orderBy(F.col("dq_invalid_pct").desc(), "column_id")
            .select("table_name", "column_name", "dq_invalid_pct"))


def q_completeness_by_table(gold: Gold) -> DataFrame:
    """Average completeness per table name, rounded exactly (completeness is
    checks passed / checks total, so the average is a ratio of integer sums)."""
    agg = gold["scores_pre"].groupBy("table_name").agg(
        F.sum("checks_passed").cast("bigint").alias("s"), F.sum("checks_total").cast("bigint").alias("n"))
    val = (half_up_div(F.col("s") * 10000, F.col("n")) / 100).alias("avg_completeness_pct")
    return finish(agg, [val], ["table_name", "avg_completeness_pct"]).orderBy(
        F.col("avg_completeness_pct").desc(), "table_name")


def q_kpis(gold: Gold) -> DataFrame:
    return gold["kpi_summary"]


def q_validation(gold: Gold) -> DataFrame:
    return gold["dlt_summary"]


def q_owners(gold: Gold, table_name: str | None = None) -> DataFrame:
    df = gold["profile"].filter(F.col("data_steward").isNotNull())
    if table_name is not None:
        df = df.filter(F.col("table_name") == table_name)
    return df.select("table_name", "data_steward")


def q_access(gold: Gold, table_name: str = "tbl_1", user_email: str = "u1@example.com") -> DataFrame:
    """Can the user access the table? Filters reach both join inputs before the
    join; among same-named tables the smallest location/id answers."""
    df = access_for(gold["asset_access_policy"], gold["user_profile"], table_name, user_email)
    return (df.orderBy("asset_location", "table_id").limit(1)
            .select("asset_location", "access_decision", "access_reason", "asset_region",
                    "policy_rationale"))


def q_restricted(gold: Gold) -> DataFrame:
    return (apply_filter(gold, "restricted").orderBy("asset_region", "table_name", "table_id")
            .select("table_name", "asset_region", "allowed_region", "required_access_group",
                    "policy_rationale"))


def q_cert_by_table(gold: Gold) -> DataFrame:
    return (gold["cert_level_summary"].orderBy(F.col("certified_pct").desc(), "table_id", *PATH)
            .select("table_name", "column_count", "certified_columns", "documented_columns",
                    "registered_columns", "unclassified_columns", "certified_pct"))


def q_domains(gold: Gold) -> DataFrame:
    return (gold["domain_summary"]
            .select("domain", "table_count", "column_count", "avg_governance_score", "certified_pct")
            .orderBy(F.col("avg_governance_score").desc(), "domain"))


def q_classification(gold: Gold) -> DataFrame:
    return (gold["pii_classification_summary"]
            .select("classification", "column_count", "pii_columns", "critical_columns",
                    "pct_of_catalog", "sensitivity_coverage_pct")
            .orderBy(F.col("column_count").desc(), "classification"))


def q_structural_issues(gold: Gold) -> DataFrame:
    return (apply_filter(gold, "outliers")
            .select("table_name", "column_count", "standard_column_count", "structural_status",
                    "corrective_action", "table_id")
            .orderBy("table_name", "table_id").drop("table_id"))


def q_structural_rate(gold: Gold) -> DataFrame:
    return gold["structural_summary"].select(
        "total_tables", "compliant_tables", "outlier_tables", "structural_consistency_pct",
        "standard_column_count")


def q_why_restricted(gold: Gold, database_name: str = "crm") -> DataFrame:
    """The policy a catalogued database's tables carry (also answers for
    databases on the default policy)."""
    return (gold["asset_access_policy"].filter(F.col("database_name") == database_name)
            .select("database_name", "asset_region", "required_access_group", "allowed_region",
                    "policy_rationale").distinct())


def q_glossary(gold: Gold) -> DataFrame:
    """Business glossary: each term with its description, subdomain and how
    many columns / tables link to it (counts, not unbounded lists)."""
    return (gold["profile"].filter(F.col("term_name").isNotNull())
            .groupBy("term_name", "term_description", "term_subdomain")
            .agg(F.count("*").alias("linked_columns"),
                 F.count_distinct("system_name", "database_name", "schema_name", "table_name")
                  .alias("linked_tables")))


def q_table_health(gold: Gold) -> DataFrame:
    """Per governance row: score, health band and number of columns with gaps in the whole
    table (the same number on each of a table's rows). Gaps are counted per table where
    the checks are, without joining the gap list back."""
    gap_tables = (gold["scores_pre"].filter(gap_reason_column() != "")
                  .groupBy("table_id").agg(F.count("*").alias("gap_columns")))
    tg = gold["table_governance"]
    return (tg.join(gap_tables, "table_id", "left")
            .select("system_name", "database_name", "schema_name", "table_id", "table_name",
                    "data_steward", "table_governance_score",
                    health_band().alias("health_band"),
                    F.coalesce(F.col("gap_columns"), F.lit(0)).alias("gap_columns")))


def q_tables_missing_steward(gold: Gold) -> DataFrame:
    """Tables with at least one column without a data steward, and how many."""
    return (apply_filter(gold, "no_steward")
            .groupBy("system_name", "database_name", "schema_name", "table_name")
            .agg(F.count("*").alias("columns_without_steward")))


def q_table_certification(gold: Gold, table_name: str = "tbl_1") -> DataFrame:
    """Achieved certification mix of the tables with this name (one row per
    system/database/schema instance)."""
    return (gold["cert_level_summary"].filter(F.col("table_name") == table_name)
            .select("system_name", "database_name", "schema_name", "table_name", "column_count",
                    "certified_columns", "documented_columns", "registered_columns",
                    "unclassified_columns", "certified_pct"))


def catalog_search(gold: Gold, pattern: str) -> DataFrame:
    """Assets whose database, schema, table or column name contains ``pattern``
    (case-insensitive)."""
    p = pattern.lower()
    s = gold["table_structure"]
    cond = None
    for c in ("database_name", "schema_name", "table_name", "column_name"):
        e = F.lower(F.col(c)).contains(p)
        cond = e if cond is None else cond | e
    return s.filter(cond).select("database_name", "schema_name", "table_name", "column_name")


QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items())
    if name.startswith("q_") and callable(fn)
}
QUESTIONS["catalog_search"] = catalog_search


def ask(gold: Gold, question: str, **params) -> DataFrame:
    if question not in QUESTIONS:
        raise KeyError(f"unknown question {question!r}; known: {sorted(QUESTIONS)}")
    return QUESTIONS[question](gold, **params)
