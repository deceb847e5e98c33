"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the
whole lineitem-derived catalog of that scale factor (plus conversations for
the query log). Plans are lazy; silver is declared once per (session, sf_dir).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.functions.labels import asset_location, gap_severity, health_band, maturity_tier
from govlens.functions.rubric import check_expression, production_rubric, rubric_from_conf
from govlens.operators import access as A
from govlens.operators import alerts as AL
from govlens.operators import gaps as G
from govlens.operators import silver as S
from govlens.operators import structure as ST
from govlens.operators.rollups import checked_estimates, kpi_rollup
from govlens.operators.search import indexed_search, write_search_index
from govlens.operators.feedback import feedback_latest, feedback_stats
from govlens.plans import semantic as SEM
from govlens.plans.hints import shared_folder
from govlens.plans.pipeline import Gold, gold_from_sf, write_table
from govlens.sources import reference as R
from govlens.sources.raw import (
    AUDIT_COLUMNS, bronze_from_lineitem, corrupt_csv_rows, csv_row_counts, lineitem_csv, raw_from_lineitem, read_raw_csv,
)

Query = Callable[[SparkSession, str], DataFrame]

_GOLD: dict[tuple[str, str], Gold] = {}

# One production check per rule kind, compiled on its own over the valid rows.
RULE_EXAMPLES = {"not_null": "CHK-06", "not_null_all": "CHK-11", "allowed_values": "CHK-07",
                 "ratio": "CHK-09"}


def gold_for(spark: SparkSession, sf_dir: str) -> Gold:
    """Gold plans over one silver per (application, sf_dir), written once to the shared
    folder and read back, so the registered queries share it and start from files."""
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _GOLD:
        folder = shared_folder(spark)
        silver = S.build_silver(_bronze(spark, sf_dir), rubric_from_conf(spark), stripped=True)
        silver = write_table(silver, f"{folder}/silver-{uuid.uuid4().hex}")
        _GOLD[k] = gold_from_sf(spark, sf_dir, silver=silver)
    return _GOLD[k]


ROWS_PER_TASK = 200_000  # raw rows take some 750 bytes each in the sort before the dedup's shuffle


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables have one row group each: their rows are dealt over the cores, and over more
    tasks as the table grows (counted from the files' footers), so that no task has to spill."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return bronze_from_lineitem(spark, sf_dir, partitions=max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def _no_audit(df: DataFrame) -> DataFrame:
    return df.drop(*AUDIT_COLUMNS)


def _prepared(spark, sf):
    return S.prepare(_bronze(spark, sf))


def _gold_table(name: str) -> Query:
    return lambda spark, sf: _no_audit(gold_for(spark, sf)[name])


def _silver(spark, sf):
    return gold_for(spark, sf).silver


_CSV: dict[tuple[str, str], str] = {}


def _csv(spark: SparkSession, sf_dir: str) -> str:
    """The raw rows as CSV files of several layouts, written once per (application, sf_dir)."""
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _CSV:
        _CSV[k] = lineitem_csv(spark, sf_dir, f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}")
    return _CSV[k]


_INDEX: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str) -> str:
    """The search index of the catalog, written once per (application, sf_dir)."""
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _INDEX:
        _INDEX[k] = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
        write_search_index(gold_for(spark, sf_dir)["table_structure"], _INDEX[k])
    return _INDEX[k]


QUERIES: dict[str, Query] = {
    # sources and silver steps
    "raw_scan": lambda spark, sf: raw_from_lineitem(spark, sf),
    "csv_scan": lambda spark, sf: _no_audit(read_raw_csv(spark, _csv(spark, sf))),
    "csv_corrupt_rows": lambda spark, sf: corrupt_csv_rows(spark, _csv(spark, sf)).drop("_source_file"),
    "csv_row_counts": lambda spark, sf: csv_row_counts(spark, _csv(spark, sf)),
    "null_tokens": lambda spark, sf: _no_audit(_bronze(spark, sf)),
    "typed_flags": lambda spark, sf: S.cast_types(_bronze(spark, sf)).select(
        F.col("column_id").alias("source_column_id"), "pii_flag", "critical_data_element_flag",
        "total_record_count", "invalid_record_count"),
    "standardized": lambda spark, sf: _no_audit(_prepared(spark, sf)),
    "surrogate_keys": lambda spark, sf: _prepared(spark, sf).select(
        "source_column_id", "database_id", "schema_id", "table_id", "column_id"),
    "quarantine": lambda spark, sf: _no_audit(S.quarantine(_bronze(spark, sf))),
    "expectation_counts": lambda spark, sf: S.expectation_counts(_prepared(spark, sf)),
    "dedup_best": lambda spark, sf: _no_audit(S.dedup_best(_prepared(spark, sf), levels=S.KEY_LEVELS)),
    "silver": lambda spark, sf: _no_audit(_silver(spark, sf)),
    "asset_completeness": lambda spark, sf: _silver(spark, sf).select(
        "column_id", S.completeness_count().alias("completeness")),
    "check_scores": lambda spark, sf: _silver(spark, sf).select(
        "column_id", "checks_passed", "checks_total", "completeness_pct", "dq_invalid_pct"),
    "achieved_cert_level": lambda spark, sf: _silver(spark, sf).select(
        "column_id", "achieved_cert_level"),
    "check_results": lambda spark, sf: G.check_results(_silver(spark, sf)),
    "typed_counts": lambda spark, sf: S.cast_types(_bronze(spark, sf)).select(
        F.col("column_id").alias("source_column_id"), "total_record_count", "invalid_record_count"),
    "normalized_strings": lambda spark, sf: S.normalize_strings(
        S.cast_types(raw_from_lineitem(spark, sf))),
    "silver_valid": lambda spark, sf: _no_audit(S.expected_rows(_prepared(spark, sf), levels=S.KEY_LEVELS)),
    "rubric_checks": lambda spark, sf: _silver(spark, sf).select(
        "column_id", *production_rubric().check_columns),
    **{f"rule_{rule}": (lambda cid: lambda spark, sf: S.expected_rows(_prepared(spark, sf), levels=S.KEY_LEVELS).select(
        "column_id", check_expression(production_rubric().by_id()[cid]).alias("passed")))(cid)
       for rule, cid in RULE_EXAMPLES.items()},
    "gates_to_next_level": lambda spark, sf: G.gates_to_next_level(_silver(spark, sf)),
    # gold tables
    **{n: _gold_table(n) for n in (
        "scores_pre", "table_governance", "table_structure", "profile", "dlt_summary",
        "kpi_summary", "cert_level_summary", "pii_classification_summary", "domain_summary",
        "structural_consistency", "structural_summary", "governance_gaps",
        "asset_access_policy", "asset_access_check")},
    "kpi_rollup": lambda spark, sf: kpi_rollup(_silver(spark, sf)),
    "approx_distinct_by_domain": lambda spark, sf: checked_estimates(_silver(spark, sf), ["domain"]),
    # reference dimensions, as used by the catalog
    "region_assignment": lambda spark, sf: A.region_rules_in_use(
        _silver(spark, sf), gold_for(spark, sf)["region_assignment"]),
    "user_access_summary": lambda spark, sf: A.user_access_summary(
        gold_for(spark, sf)["asset_access_policy"], gold_for(spark, sf)["user_profile"]),
    "modal_standard": lambda spark, sf: ST.modal_standard(ST.table_column_counts(_silver(spark, sf))),
    "structural_override": lambda spark, sf: ST.structural_consistency(_silver(spark, sf), standard=8),
    # gaps and checklists
    "gap_reasons": lambda spark, sf: G.gap_reasons(gold_for(spark, sf)["governance_gaps"]),
    "top_gaps_by_domain": lambda spark, sf: G.top_gaps_by_domain(_silver(spark, sf), 3),
    "gaps_by_steward": lambda spark, sf: G.gaps_by_steward(_silver(spark, sf)),
    "cert_checklist": lambda spark, sf: G.cert_checklist(_silver(spark, sf)),
    "unclassified_pii": lambda spark, sf: G.unclassified_pii(_silver(spark, sf)),
    # fields
    "field_asset_location": lambda spark, sf: gold_for(spark, sf)["table_structure"].select(
        "column_id", asset_location().alias("asset_location")),
    "field_health_band": lambda spark, sf: gold_for(spark, sf)["table_governance"].select(
        "table_id", "data_steward", "table_desc", "system_name", "database_name", "schema_name",
        "table_governance_score", health_band().alias("health_band")),
    "maturity_tier": lambda spark, sf: _silver(spark, sf).select(
        "column_id", "completeness_pct", maturity_tier().alias("maturity_tier")),
    "gap_severity": lambda spark, sf: gold_for(spark, sf)["governance_gaps"].select(
        "column_id", "gap_reason", gap_severity().alias("gap_severity")),
    # filters, measures, joins, questions
    **{f"filter_{n}": (lambda n: lambda spark, sf: SEM.apply_filter(gold_for(spark, sf), n))(n)
       for n in SEM.FILTERS},
    **{f"measure_{n}": (lambda n: lambda spark, sf: SEM.measure(gold_for(spark, sf), n))(n)
       for n in SEM.MEASURES},
    "measure_certified_by_domain": lambda spark, sf: SEM.measure(
        gold_for(spark, sf), "certified", by=["domain"]),
    "measure_completeness_by_steward": lambda spark, sf: SEM.measure(
        gold_for(spark, sf), "completeness", by=["data_steward"]),
    **{f"join_{n}": (lambda fn: lambda spark, sf: fn(gold_for(spark, sf)))(fn)
       for n, fn in SEM.JOINS.items()},
    **{f"q_{n}": (lambda fn: lambda spark, sf: fn(gold_for(spark, sf)))(fn)
       for n, fn in SEM.QUESTIONS.items() if n != "catalog_search"},
    "catalog_search": lambda spark, sf: SEM.catalog_search(gold_for(spark, sf), "col_1"),
    "catalog_search_indexed": lambda spark, sf: indexed_search(spark, _index(spark, sf), "col_1"),
    # dashboard, alerts, status
    "app_top_tables": lambda spark, sf: AL.top_tables(gold_for(spark, sf)["table_governance"]),
    "app_worst_gaps": lambda spark, sf: AL.worst_gaps(gold_for(spark, sf)["governance_gaps"]),
    "app_domains": lambda spark, sf: AL.domains_view(gold_for(spark, sf)["domain_summary"]),
    "kpi_cards": lambda spark, sf: AL.kpi_cards(gold_for(spark, sf)["kpi_summary"]),
    "dq_ratio": lambda spark, sf: AL.dq_ratio(gold_for(spark, sf)["dlt_summary"]),
    "cert_distribution": lambda spark, sf: AL.cert_distribution(gold_for(spark, sf)["kpi_summary"]),
    "sql_alerts": lambda spark, sf: AL.sql_alerts(gold_for(spark, sf)["kpi_summary"],
                                                  gold_for(spark, sf)["structural_summary"]),
    "rule_alerts": lambda spark, sf: AL.rule_alerts(gold_for(spark, sf)["dlt_summary"],
                                                    gold_for(spark, sf)["structural_summary"],
                                                    gold_for(spark, sf)["governance_gaps"]),
    "alert_counts": lambda spark, sf: AL.alert_counts(AL.sql_alerts(
        gold_for(spark, sf)["kpi_summary"], gold_for(spark, sf)["structural_summary"])),
    "alerts_new": lambda spark, sf: AL.new_alerts(AL.rule_alerts(
        gold_for(spark, sf)["dlt_summary"], gold_for(spark, sf)["structural_summary"],
        gold_for(spark, sf)["governance_gaps"]),
        spark.createDataFrame([("pii_inconsistent",)], "rule_id string")).drop("fired_at"),
    "pipeline_status": lambda spark, sf: AL.pipeline_status(
        gold_for(spark, sf)["dlt_summary"], gold_for(spark, sf)["structural_summary"],
        source="lineitem", checks=len(rubric_from_conf(spark).checks)),
    "pipeline_totals": lambda spark, sf: AL.pipeline_totals(gold_for(spark, sf)["dlt_summary"],
                                                            gold_for(spark, sf)["structural_summary"]),
    # assistant monitoring
    "feedback_stats": lambda spark, sf: feedback_stats(R.query_log(spark, sf)),
    "feedback_latest": lambda spark, sf: feedback_latest(R.query_log(spark, sf),
                                                         R.feedback_clicks(spark, sf)),
}
