"""What the dedup shuffles, how the raw rows are dealt, and what the search index stores."""

import random

from conftest import SF_SMALL, good_row, raw_rows

from govlens.operators import search
from govlens.operators import silver as S
from govlens.plans import registry
from govlens.sources.raw import RAW_COLUMNS, bronze_from_lineitem, to_bronze


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_packed_texts_order_and_come_back(spark):
    rng = random.Random(5)
    values = [None, "", "a", "ab", "b", "\x00", "\x01", "\x00\x01", "\x01\x00", "\x01\x01\x02", "a\x00", "a\x01b", "\x02", "ü", "\x01\x02\x00"]
    rows = [tuple(rng.choice(values) for _ in range(3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "x string, y string, z string").withColumn("p", S.packed(["x", "y", "z"]))
    back = df.select("x", "y", "z", S.unpacked("p").alias("u")).collect()
    assert all([r.x, r.y, r.z] == r.u for r in back)
    by_columns = [(r.x, r.y, r.z) for r in df.orderBy("x", "y", "z").collect()]
    assert [(r.x, r.y, r.z) for r in df.orderBy("p").collect()] == by_columns


def test_dedup_without_ids_in_the_shuffle_keeps_the_same_rows(spark):
    rng = random.Random(6)
    rows = [good_row(column_id=rng.choice([None, "1", "2"]), column_name=rng.choice([None, "n", "M", "m "]),
                     schema_name=rng.choice([None, "s"]), table_name=rng.choice(["t", "T"]), **{
                         c: rng.choice([None, "", "a", "b\x00", "b\x01", "true"]) for c in RAW_COLUMNS[2:9]}) for _ in range(400)]
    prepared = S.prepare(to_bronze(raw_rows(spark, rows), source="test")).drop("_ingestion_timestamp").localCheckpoint()

    def both(df):
        return sorted(map(repr, df.collect()))

    found = S.dedup_best(prepared, levels=S.KEY_LEVELS)
    assert found.columns == prepared.columns
    assert both(found) == both(S.dedup_best(prepared)) and found.count() > 2
    assert both(S.expected_rows(prepared, levels=S.KEY_LEVELS)) == both(S.expected_rows(prepared))


def test_no_hashes_are_shuffled(spark):
    bronze = bronze_from_lineitem(spark, SF_SMALL)
    for df in (S.build_silver(bronze, stripped=True), S.dedup_best(S.prepare(bronze), levels=S.KEY_LEVELS),
               registry.QUERIES["silver_valid"](spark, SF_SMALL), registry.QUERIES["rule_allowed_values"](spark, SF_SMALL)):
        below = plan_of(df)[0].split("Aggregate", 1)[1]
        assert "sha2" not in below


def test_raw_rows_are_dealt_over_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 100)
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    df = registry._bronze(spark, SF_SMALL)
    assert f", {-(-rows // 100)})" in plan_of(df)[1].replace(", REPARTITION_BY_NUM", ")") and rows > 1000
    assert df.count() == rows


def test_the_index_stores_no_ids_and_gives_each_row_once(spark, tmp_path):
    rows = [("1", "col_db", "col_s", "col_t", "COL_x"), ("2", "d", "s", "xcol_", None), ("3", None, "s", "t", "c"),
            ("4", "same", "SAME", "same_col_", "same"), ("5", "col_db", "col_s", "col_t", "COL_x")]
    catalog = spark.createDataFrame(rows, "column_id string, database_name string, schema_name string, table_name string, column_name string")
    search.write_search_index(catalog, f"{tmp_path}/index", 4)
    assert "column_id" not in spark.read.parquet(f"{tmp_path}/index/rows").columns
    for pattern, want in (("col_", (0, 1, 3, 4)), ("same", (3,)), ("s", (0, 1, 2, 3, 4)), ("c", (0, 1, 2, 3, 4)), ("zzz", ())):
        got = search.indexed_search(spark, f"{tmp_path}/index", pattern, 4)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(rows[i][1:]) for i in want), pattern
