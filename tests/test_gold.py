"""Gold tables: invariants, boundaries and small hand-made cases."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, good_row, raw_rows
from govlens.operators import access, gaps, rollups, scoring, structure
from govlens.operators.silver import build_silver
from govlens.plans.pipeline import gold_from_sf
from govlens.sources import reference
from govlens.sources.raw import to_bronze


@pytest.fixture(scope="module")
def gold(spark):
    return gold_from_sf(spark, SF_SMALL)


def test_level_counts_sum_to_total(gold):
    k = gold["kpi_summary"].first()
    assert (k["certified_columns"] + k["documented_columns"] + k["registered_columns"]
            + k["unclassified_columns"]) == k["total_columns"] == 1718


def test_dlt_summary_partitions_rows(gold):
    d = gold["dlt_summary"].first()
    assert d["dq_pass_rows"] + d["dq_failed_rows"] == d["silver_valid_rows"]
    assert d["pii_consistent_rows"] + d["pii_inconsistent_rows"] == d["silver_valid_rows"]


def test_structural_partition(gold):
    s = gold["structural_summary"].first()
    assert s["compliant_tables"] + s["outlier_tables"] == s["total_tables"]
    sc = gold["structural_consistency"]
    assert sc.filter(F.col("is_outlier") != (F.col("structural_status") != "Compliant")).count() == 0


def test_access_check_is_tables_times_users(gold):
    n_tables = gold["asset_access_policy"].count()
    n_users = gold["user_profile"].count()
    chk = gold["asset_access_check"]
    assert chk.count() == n_tables * n_users
    by = {r["access_decision"]: r["count"] for r in chk.groupBy("access_decision").count().collect()}
    assert sum(by.values()) == n_tables * n_users


def test_mismatched_user_never_eligible_for_restricted(gold):
    rows = gold["asset_access_check"].filter(
        (F.col("user_email") == "u9@example.com") & (F.col("asset_region") != "UNRESTRICTED"))
    assert rows.filter(F.col("access_decision") == "Eligible").count() == 0


def test_policy_fails_open_case_sensitively(spark, gold):
    pol = gold["asset_access_policy"]
    upper = pol.filter(F.col("database_name") == "Finance_DW").select("is_default_policy").distinct().collect()
    assert [r[0] for r in upper] == [True]
    ci = access.asset_access_policy(gold.silver, reference.region_assignment(spark), case_insensitive=True)
    assert ci.filter((F.col("database_name") == "Finance_DW") & F.col("is_default_policy")).count() == 0


def test_table_ids_unique_in_policy(gold):
    pol = gold["asset_access_policy"]
    assert pol.select("table_id").distinct().count() == pol.count()


def test_pct_of_catalog_sums_to_100(gold):
    tot = gold["pii_classification_summary"].agg(F.sum("column_count")).first()[0]
    assert tot == 1718


def _structural_fixture(spark, counts):
    rows = []
    for t, n in counts.items():
        for c in range(n):
            rows.append(good_row(column_id=f"{t}-{c}", table_name=t, column_name=f"c{c}"))
    return build_silver(to_bronze(raw_rows(spark, rows), source="t"))


def test_modal_tie_goes_to_smallest(spark):
    s = _structural_fixture(spark, {"a": 5, "b": 5, "c": 8, "d": 8, "e": 12})
    sc = structure.structural_consistency(s)
    assert {r["standard_column_count"] for r in sc.collect()} == {5}
    r = {x["table_name"]: x for x in sc.collect()}
    assert r["a"]["lower_bound"] == 4.0 and r["a"]["upper_bound"] == 7.0
    assert r["c"]["structural_status"] == "Outlier: too many columns"
    assert r["a"]["structural_status"] == "Compliant"


def test_bounds_are_inclusive_and_override(spark):
    s = _structural_fixture(spark, {"a": 10, "b": 7, "c": 13, "d": 6, "e": 14})
    sc = {r["table_name"]: r for r in structure.structural_consistency(s, standard=10).collect()}
    assert sc["b"]["structural_status"] == "Compliant" and sc["c"]["structural_status"] == "Compliant"
    assert sc["d"]["structural_status"] == "Outlier: too few columns"
    assert sc["e"]["structural_status"] == "Outlier: too many columns"
    assert "has 6 columns vs the standard of 10" in sc["d"]["corrective_action"]


def test_empty_input(spark):
    s = build_silver(to_bronze(raw_rows(spark, []), source="t"))
    assert structure.structural_consistency(s).count() == 0
    k = rollups.kpi_summary(s).first()
    assert k["total_columns"] == 0 and k["certified_pct"] is None and k["avg_columns_per_table"] is None
    assert rollups.pii_classification_summary(s).count() == 0


def test_scores_use_unrounded_inputs(spark):
    s = build_silver(to_bronze(raw_rows(spark, [good_row(invalid_record_count="333",
                                                         total_record_count="1000")]), source="t"))
    r = scoring.scores_pre(s).first()
    assert r["quality_score"] == 66.7
    assert r["overall_governance_score"] == round(100 * 10 / 11 * 0.5 + 66.7 * 0.3 + 100 * 0.2, 2)


def test_gap_reasons_and_severity(spark):
    s = build_silver(to_bronze(raw_rows(spark, [good_row(data_steward=None, tag_name="team")]),
                               source="t"))
    g = gaps.governance_gaps(s).first()
    assert g["gap_reason"] == "Missing data steward, Missing domain tag"
    sev = {r["reason"]: r["severity"] for r in gaps.gap_reasons(gaps.governance_gaps(s)).collect()}
    assert sev == {"Missing data steward": "Critical", "Missing domain tag": "Medium"}


def test_clean_asset_has_no_gap(spark):
    s = build_silver(to_bronze(raw_rows(spark, [good_row()]), source="t"))
    assert gaps.governance_gaps(s).count() == 0
    nxt = gaps.gates_to_next_level(s).first()
    assert nxt["next_level"] is None and nxt["missing_checks"] == ""


def test_gates_to_next_level(spark):
    s = build_silver(to_bronze(raw_rows(spark, [good_row(term_name=None, tag_name="team")]),
                               source="t"))
    r = gaps.gates_to_next_level(s).first()
    assert r["achieved_cert_level"] == "Registered"
    assert r["next_level"] == "Documented" and r["missing_checks"] == "CHK-05"


def test_check_results_long_form(spark):
    s = build_silver(to_bronze(raw_rows(spark, [good_row(pii_flag=None)]), source="t"))
    cr = gaps.check_results(s).collect()
    assert len(cr) == 11
    failed = [r for r in cr if not r["passed"]]
    assert [r["check_id"] for r in failed] == ["CHK-08"]
    assert failed[0]["severity"] == "critical" and failed[0]["fail_message"].startswith("pii_flag")


def test_bucketed_silver_avoids_exchange(spark, gold, tmp_path):
    from govlens.plans.pipeline import gold_tables, write_bucketed

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = write_bucketed(gold.silver, "silver_bucketed_test", buckets=4, path=str(tmp_path / "s"))
        g = gold_tables(s, reference.region_assignment(spark), reference.user_profile(spark))
        plan = g["cert_level_summary"]._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert g["cert_level_summary"].count() == gold["cert_level_summary"].count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_kpi_approx_close_to_exact(gold):
    exact = rollups.kpi_summary(gold.silver).first()
    approx = rollups.kpi_summary(gold.silver, approx=True).first()
    for c in ("total_tables", "total_schemas", "total_databases"):
        assert abs(approx[c] - exact[c]) <= max(2, 0.05 * exact[c])
    assert approx["total_columns"] == exact["total_columns"]


def test_run_pipeline_writes_all_tables(spark, tmp_path):
    from govlens.plans.pipeline import STORED_TABLES, run_pipeline
    from govlens.sources.raw import bronze_from_lineitem

    out = run_pipeline(spark, bronze_from_lineitem(spark, SF_SMALL), str(tmp_path),
                       silver_table="silver_pipeline_test", buckets=4)
    assert set(out) == {"silver", "quarantine", *STORED_TABLES}
    assert out["silver"].count() == 1718
    assert out["kpi_summary"].first()["total_columns"] == 1718
    assert out["quarantine"].filter("_failed_expectations != ''").count() == out["quarantine"].count() > 0


def test_conf_overrides(spark, tmp_path):
    import yaml

    from govlens.functions.rubric import PRODUCTION_RUBRIC
    from govlens.plans.pipeline import gold_from_sf

    rub = dict(PRODUCTION_RUBRIC)
    rub["certification_levels"] = [{"name": "Registered", "gate_checks": ["CHK-01"]}]
    p = tmp_path / "rubric.yaml"
    p.write_text(yaml.safe_dump(rub))
    spark.conf.set("rubric.path", str(p))
    spark.conf.set("structural.standard_column_count", "5")
    try:
        g = gold_from_sf(spark, SF_SMALL)
        levels = {r[0] for r in g.silver.select("achieved_cert_level").distinct().collect()}
        assert levels == {"Registered"}
        stds = {r[0] for r in g["structural_consistency"].select("standard_column_count").distinct().collect()}
        assert stds == {5}
    finally:
        spark.conf.unset("rubric.path")
        spark.conf.unset("structural.standard_column_count")
