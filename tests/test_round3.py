"""Expectations counted by the write, siblings read back, the access grid, the KPI roll-up."""

import os

import pytest
from conftest import SF_SMALL, good_row, raw_rows
from pyspark.sql import functions as F

from govlens.operators import access as A
from govlens.operators import rollups
from govlens.operators import search
from govlens.operators import silver as S
from govlens.plans.pipeline import gold_tables, run_pipeline, write_gold
from govlens.plans.semantic import catalog_search
from govlens.sources import reference as R
from govlens.sources.raw import bronze_from_lineitem, to_bronze
from govlens.streaming import incremental as I


def test_expectations_are_counted_by_the_write(spark, tmp_path):
    bronze = bronze_from_lineitem(spark, SF_SMALL)
    run_pipeline(spark, bronze, str(tmp_path), tables=["dlt_summary"], stripped=True)
    want = {tuple(r) for r in S.expectation_counts(S.prepare(bronze)).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/expectations").collect()} == want and len(want) == 3
    assert any(failed for _, _, failed in want)


def test_other_rules_are_observed_too(spark):
    from pyspark.sql import Observation

    rows = to_bronze(raw_rows(spark, [good_row(), good_row(column_name="b", data_steward=None), good_row(table_name=None)]))
    rules = {"steward": "data_steward IS NOT NULL", "valid_table_id": "table_id IS NOT NULL"}
    seen = Observation()
    assert S.build_silver(rows, rules=rules, observation=seen).count() >= 1
    assert {tuple(r) for r in S.expectation_report(spark, seen, rules).collect()} == {("steward", 2, 1), ("valid_table_id", 2, 1)}


def test_siblings_are_read_back(spark, tmp_path):
    silver = S.build_silver(bronze_from_lineitem(spark, SF_SMALL), stripped=True)
    silver.write.parquet(f"{tmp_path}/silver")
    tables = ["structural_summary", "scores_pre", "structural_consistency", "domain_summary"]

    def gold():
        return gold_tables(spark.read.parquet(f"{tmp_path}/silver"), R.region_assignment(spark), R.user_profile(spark))

    g = gold()
    out = write_gold(g, str(tmp_path / "out"), tables)
    assert list(out) == tables
    for name, source in (("structural_summary", "structural_consistency"), ("domain_summary", "scores_pre")):
        assert {f.split("/")[-2] for f in g._build(name).inputFiles()} == {source}
        assert out[name].exceptAll(gold()[name]).count() == 0 and out[name].count() == gold()[name].count()


@pytest.mark.parametrize("n_tables,n_users", [(3, 2), (2500, 600)])
def test_access_grid_grows_with_both_sides(spark, n_tables, n_users):
    policy = spark.range(n_tables).selectExpr(
        "CAST(id AS STRING) AS table_id", "'d' AS database_name", "'s' AS schema_name", "concat('t', id) AS table_name",
        "IF(id % 2 = 0, 'UNRESTRICTED', 'EU') AS asset_region", "'g' AS required_access_group", "'EU' AS allowed_region",
        "'why' AS policy_rationale", "false AS is_default_policy")
    users = spark.range(n_users).selectExpr(
        "concat('u', id) AS user_email", "IF(id % 3 = 0, 'EU', 'US') AS user_region", "'x' AS department", "'g' AS access_group")
    got = A.asset_access_check(policy, users).groupBy("access_decision").count().collect()
    even, eu = (n_tables + 1) // 2, (n_users + 2) // 3
    eligible = even * n_users + (n_tables - even) * eu
    assert {r[0]: r[1] for r in got} == {"Eligible": eligible, "Not Eligible": n_tables * n_users - eligible}
    one = A.access_for(policy, users, "t1", "u0").collect()
    assert [(r.table_id, r.access_decision) for r in one] == [("1", "Eligible")]
    parts = policy.limit(1).select(A._parts(policy, A.CELL_TABLES).alias("t"), A._parts(users, A.CELL_USERS).alias("u")).first()
    assert tuple(parts) == (-(-n_tables // 1024), -(-n_users // 256))


def test_rollup_levels_add_up(spark):
    silver = S.build_silver(bronze_from_lineitem(spark, SF_SMALL), stripped=True).cache()
    rows = rollups.kpi_rollup(silver).collect()
    by = {level: [r for r in rows if r.level == level] for level in rollups.ROLLUP_LEVELS}
    one, kpi = by["estate"][0], rollups.kpi_summary(silver).first()
    for c in ("total_columns", "total_tables", "total_schemas", "total_databases", "avg_completeness_pct",
              "avg_dq_invalid_pct", "pii_columns", "critical_columns", "certified_columns"):
        assert one[c] == kpi[c], c
    for level in rollups.ROLLUP_LEVELS:
        assert sum(r.total_columns for r in by[level]) == one.total_columns
    assert (len(by["database"]), len(by["schema"]), len(by["table"])) == (one.total_databases, one.total_schemas, one.total_tables)
    silver.unpersist()
    assert rollups.kpi_rollup(silver.limit(0)).count() == 0


def test_sketches_merge_for_any_grouping(spark, tmp_path):
    silver = S.build_silver(bronze_from_lineitem(spark, SF_SMALL), stripped=True)
    silver.write.parquet(f"{tmp_path}/silver")
    silver = spark.read.parquet(f"{tmp_path}/silver")
    rollups.distinct_sketches(silver).write.parquet(f"{tmp_path}/sketches")
    stored = spark.read.parquet(f"{tmp_path}/sketches")
    exact = silver.withColumn("domain", rollups.domain_column())
    for by in ([], ["domain"], ["database_name", "achieved_cert_level"]):
        got = rollups.approx_distinct(stored, by)
        assert {f.split("/")[-2] for f in got.inputFiles()} == {"sketches"}
        want = exact.groupBy(*by).agg(*[F.count_distinct(f"{i}_id").alias(i) for i in ("table", "schema", "database")]).collect()
        rows = {tuple(r[b] for b in by): r for r in got.collect()}
        assert len(rows) == len(want)
        for w in want:
            r = rows[tuple(w[b] for b in by)]
            for i in ("table", "schema", "database"):  # five standard errors of 1.6 %
                assert abs(r[f"approx_{i}s"] - w[i]) <= max(1, 0.08 * w[i])


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upserts_equal_batch_silver(spark, tmp_path):
    bronze = bronze_from_lineitem(spark, SF_SMALL)
    parts = bronze.randomSplit([1.0, 1.0, 1.0], 7)
    for part in parts:
        part.write.mode("append").parquet(f"{tmp_path}/bronze")
    run = I.upsert_stream(spark, f"{tmp_path}/bronze", f"{tmp_path}/table", f"{tmp_path}/check", buckets=5, max_files_per_trigger=4)
    run.awaitTermination()
    assert len(files(f"{tmp_path}/table")) <= 5
    drop = ["_ingestion_timestamp"]
    got, want = I.stored_silver(spark, f"{tmp_path}/table").drop(*drop), S.build_silver(bronze).drop(*drop)
    got = got.select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # a batch of one row copies one bucket, and its repetition changes nothing
    before = files(f"{tmp_path}/table")
    one = S.prepare(bronze.filter("column_name IS NOT NULL").limit(1))
    for _ in range(2):
        I.upsert_best(one, f"{tmp_path}/table", 5)
    after = files(f"{tmp_path}/table")
    assert len(set(before) & set(after)) == len(before) - 1 and len(after) == len(before)
    assert I.stored_silver(spark, f"{tmp_path}/table").drop(*drop).select(*want.columns).exceptAll(want).count() == 0


def test_rules_fire_once_over_replays_and_writers(spark, tmp_path):
    schema = "rule_id string, name string, triggered boolean"

    def alert(*rows):
        spark.createDataFrame([(r, f"rule {r}", t) for r, t in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/alerts")

    def fired():
        I.fire_once_stream(spark, f"{tmp_path}/alerts", f"{tmp_path}/fired", f"{tmp_path}/check", schema).awaitTermination()
        return sorted(r.rule_id for r in spark.read.parquet(f"{tmp_path}/fired").collect())

    alert(("a", True), ("b", False))
    assert fired() == ["a"]
    alert(("a", True), ("b", True))
    alert(("b", True), ("c", True))
    assert fired() == ["a", "b", "c"]
    os.remove(f"{tmp_path}/check/commits/1")  # as if the driver had died before the batch was committed
    crc = f"{tmp_path}/check/commits/.1.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert fired() == ["a", "b", "c"]


def test_indexed_search_equals_the_scan(spark, tmp_path):
    silver = S.build_silver(bronze_from_lineitem(spark, SF_SMALL), stripped=True)
    silver.write.parquet(f"{tmp_path}/silver")
    gold = gold_tables(spark.read.parquet(f"{tmp_path}/silver"), R.region_assignment(spark), R.user_profile(spark))
    path = f"{tmp_path}/index"
    search.write_search_index(gold["table_structure"], path, 16)
    for pattern in ("col_1", "TBL_19", "finance_", "x", "l_1", "no such name", "bl_"):
        got = search.indexed_search(spark, path, pattern, 16)
        want = catalog_search(gold, pattern)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), pattern
    grams = search.matching_names(spark, path, "tbl_19", 16)
    plan = grams._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: ")[1][:20] and "In(gram, [" in plan.split("PushedFilters: ")[1]
    read = spark.read.parquet(f"{path}/grams")
    assert len(grams.inputFiles()) <= len(read.inputFiles())
