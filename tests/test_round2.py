"""Joins that keep rows, measures by key, rubrics of any size, CSV headers, plans of the gold tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, good_row, raw_rows
from govlens.functions.exact import half_up_div
from govlens.functions.rubric import PRODUCTION_RUBRIC, parse_rubric
from govlens.operators import access, alerts, rollups
from govlens.operators.silver import build_silver
from govlens.plans import semantic as SEM
from govlens.plans.pipeline import gold_tables
from govlens.sources import reference
from govlens.plans.pipeline import run_pipeline
from govlens.sources.raw import (
    RAW_COLUMNS, MissingColumnsError, bronze_from_lineitem, csv_row_counts, read_raw_csv, split_raw_csv, to_bronze,
)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def gold_of(spark, rows=None, rubric=None):
    bronze = to_bronze(raw_rows(spark, rows), source="t") if rows else bronze_from_lineitem(spark, SF_SMALL)
    return gold_tables(build_silver(bronze, rubric), reference.region_assignment(spark), reference.user_profile(spark))


@pytest.fixture(scope="module")
def gold(spark):
    return gold_of(spark)


@pytest.mark.parametrize("num,den,want", [
    (11_000_000_000_000 * 8500 + 5_499_999_999_999, 11_000_000_000_000, 8500),
    (11_000_000_000_000 * 8500 + 5_500_000_000_000, 11_000_000_000_000, 8501),
    (9_000_000_000_000_000_000, 1_000_000_000_000, 9_000_000), (-7, 2, -4), (7, 2, 4), (0, 5, 0), (1, 0, None)])
def test_division_is_exact(spark, num, den, want):
    df = spark.createDataFrame([(num, den)], "n long, d long")
    assert df.select(half_up_div(F.col("n"), F.col("d")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("dropped", [1, 2])
def test_completeness_of_smaller_rubrics(spark, dropped):
    rub = {**PRODUCTION_RUBRIC, "checks": PRODUCTION_RUBRIC["checks"][:-dropped],
           "certification_levels": [{"name": "Registered", "gate_checks": ["CHK-01"]}]}
    g = gold_of(spark, rubric=parse_rubric(rub))
    mean = g.silver.agg(F.avg("completeness_pct")).first()[0]
    assert SEM.measure(g, "completeness").first()[0] == pytest.approx(mean, rel=1e-12)
    per = {r[0]: r[1] for r in SEM.q_completeness_by_table(g).collect()}
    for r in g.silver.groupBy("table_name").agg(F.avg("completeness_pct").alias("m")).collect():
        assert per[r.table_name] == pytest.approx(r.m, abs=0.0051)


def test_measures_by_key(spark, gold):
    total = SEM.measure(gold, "certified").first()[0]
    by = SEM.measure(gold, "certified", by=["domain"])
    assert by.columns == ["domain", "measure_certified"] and by.agg(F.sum("measure_certified")).first()[0] == total
    assert SEM.measure(gold, "certified", "pii", by=["data_steward", "database_name"]).count() > 3
    assert SEM.measure(gold, "completeness", "pii").first()[0] > 0
    with pytest.raises(ValueError):
        SEM.measure(gold, "certified", by=["no_such_field"])
    with pytest.raises(ValueError):
        SEM.measure(gold, "certified", "outliers")
    assert SEM.ask(gold, "kpis").count() == 1
    with pytest.raises(KeyError):
        SEM.ask(gold, "unknown")


def test_two_descriptions_do_not_multiply_rows(spark):
    g = gold_of(spark, [good_row(column_id=f"r{i}", column_name=f"c{i}", table_desc=f"desc {i % 2}") for i in range(4)])
    assert g["table_governance"].count() == 2
    rows = SEM.join_profile_governance(g).collect()
    assert len(rows) == 4 and all(r["column_count"] == 2 for r in rows)
    assert SEM.join_profile_governance_declared(g).count() == 8


def test_access_at_many_users(spark, gold):
    users = spark.range(300_000).select(
        F.concat(F.lit("n"), "id", F.lit("@example.com")).alias("user_email"), F.lit("x").alias("user_country"),
        F.when(F.col("id") % 3 == 0, "US").otherwise("Europe").alias("user_region"),
        F.lit("x").alias("employee_location"), F.lit("x").alias("department"),
        F.when(F.col("id") % 2 == 0, "US_EMPLOYEES").otherwise("EU_EMPLOYEES").alias("access_group"))
    policy = gold["asset_access_policy"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (access.asset_access_check(policy, users), access.user_access_summary(policy, users)):
            text = plan(df)
            assert "Cartesian" not in text and "NestedLoop" not in text
            for line in text.splitlines():
                if "Join" in line:
                    assert "asset_region" not in line and "allowed_region" not in line.split("]")[0]
        n = policy.count()
        few = access.user_access_summary(policy, users.limit(50)).collect()
        assert len(few) == 50 and all(r.eligible_tables + r.restricted_tables == n for r in few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_access_summary_equals_the_pairs(spark, gold):
    policy, users = gold["asset_access_policy"], gold["user_profile"]
    pairs = access.asset_access_check(policy, users)
    assert pairs.count() == policy.count() * users.count()
    want = pairs.groupBy("user_email").agg(F.count_if(F.col("access_decision") == "Eligible").alias("n"))
    assert {tuple(r) for r in want.collect()} == {
        (r.user_email, r.eligible_tables) for r in access.user_access_summary(policy, users).collect()}


def csv(path, header, *lines):
    path.write_text("\n".join([",".join(header), *lines]) + "\n")


def test_csv_files_are_bound_by_name(spark, tmp_path):
    line = ",".join(f"v{i}" for i in range(len(RAW_COLUMNS)))
    swapped = [RAW_COLUMNS[1], RAW_COLUMNS[0], *RAW_COLUMNS[2:]]
    csv(tmp_path / "a.csv", swapped, line)
    csv(tmp_path / "b.csv", RAW_COLUMNS, line)
    csv(tmp_path / "c.csv", ["more", *RAW_COLUMNS], "x," + line)
    (tmp_path / "empty.csv").write_text("")
    rows = {r["_source_file"].rsplit("/", 1)[1]: (r[RAW_COLUMNS[0]], r[RAW_COLUMNS[1]], r[RAW_COLUMNS[-1]])
            for r in read_raw_csv(spark, str(tmp_path)).collect()}
    assert rows == {"a.csv": ("v1", "v0", "v25"), "b.csv": ("v0", "v1", "v25"), "c.csv": ("v0", "v1", "v25")}


def test_missing_csv_column_names_its_file(spark, tmp_path):
    line = ",".join(f"v{i}" for i in range(len(RAW_COLUMNS)))
    csv(tmp_path / "a.csv", RAW_COLUMNS, line)
    csv(tmp_path / "b.csv", RAW_COLUMNS[:-1], line)
    with pytest.raises(MissingColumnsError, match=f"b.csv lacks columns: {RAW_COLUMNS[-1]}"):
        read_raw_csv(spark, str(tmp_path))


def test_corrupt_csv_rows_are_kept_apart(spark, tmp_path):
    line = ",".join(f"v{i}" for i in range(len(RAW_COLUMNS)))
    csv(tmp_path / "a.csv", RAW_COLUMNS, line, "short,row", line + ",more")
    csv(tmp_path / "b.csv", ["more", *RAW_COLUMNS[::-1]], "x," + line, line)
    good, corrupt = split_raw_csv(spark, str(tmp_path))
    assert sorted(r.column_id for r in good.collect()) == ["v0", "v25"]
    assert sorted((r["_source_file"].rsplit("/", 1)[1], r["_raw_text"], r["_failed_expectations"]) for r in corrupt.collect()) == [
        ("a.csv", "short,row", "corrupt_record"), ("a.csv", line + ",more", "corrupt_record"), ("b.csv", line, "corrupt_record")]
    assert csv_row_counts(spark, str(tmp_path)).first() == (2, 3)
    out = run_pipeline(spark, good, str(tmp_path / "out"), tables=["kpi_summary"], corrupt=corrupt)
    assert out["quarantine"].filter("_failed_expectations = 'corrupt_record'").count() == 3


def test_plans(spark, gold):
    assert "Expand" not in plan(rollups.kpi_summary(gold.silver))
    assert plan(SEM.q_table_health(gold)).count("Join") <= 2 * 2


def test_fired_alerts_are_remembered(spark, gold, tmp_path):
    path = str(tmp_path / "fired")
    rules = alerts.rule_alerts(gold["dlt_summary"], gold["structural_summary"], gold["governance_gaps"])
    first = alerts.new_alerts(rules, alerts.fired_rules(spark, path))
    n = first.count()
    assert n > 0
    alerts.record_fired(first, path)
    assert alerts.new_alerts(rules, alerts.fired_rules(spark, path)).count() == 0
    alerts.reset_fired(spark, path)
    assert alerts.new_alerts(rules, alerts.fired_rules(spark, path)).count() == n


def test_domain_view_takes_k(spark, gold):
    every = alerts.domains_view(gold["domain_summary"])
    assert alerts.domains_view(gold["domain_summary"], 2).collect() == every.collect()[:2]


def test_critical_columns_exist(spark, gold):
    assert SEM.measure(gold, "cde").first()[0] > 0 and SEM.q_cde(gold).count() > 0


def test_registered_tables_have_comments(spark, gold, tmp_path):
    from govlens.plans.pipeline import GOLD_TABLES, TABLE_COMMENTS, write_gold

    assert set(TABLE_COMMENTS) == {"silver", *GOLD_TABLES}
    write_gold(gold, str(tmp_path), ["kpi_summary"], catalog_prefix="commented_")
    rows = spark.sql("DESCRIBE TABLE EXTENDED commented_kpi_summary").collect()
    assert [r.data_type for r in rows if r.col_name == "Comment"] == [TABLE_COMMENTS["kpi_summary"]]
