"""What moves in the dedup, as one text, and the CSV files' size."""

import random
from datetime import datetime

from conftest import SF_SMALL

from govlens.operators import silver as S
from govlens.plans import registry
from govlens.sources import raw as R


def test_numbers_times_and_flags_order_as_text_and_come_back(spark):
    rng = random.Random(7)
    longs = [None, 0, 1, 9, 10, 99, 100, -1, -9, -10, -100, (1 << 63) - 1, -(1 << 63)] + [rng.randrange(-10**6, 10**6) for _ in range(50)]
    times = [None, datetime(1900, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 2, 29, 1, 2, 3, 4)]
    rows = [(rng.choice(longs), rng.choice([None, True, False]), rng.choice(times)) for _ in range(500)]
    df = spark.createDataFrame(rows, "n bigint, b boolean, t timestamp")
    texts = S.packed([S.ordered_text(c, t) for c, t in df.dtypes])
    df = df.withColumn("p", texts).withColumn("u", S.unpacked("p"))
    back = df.select("n", "b", "t", *[S.from_ordered_text(df["u"][i], t).alias(f"r{i}") for i, (_, t) in enumerate(df.dtypes[:3])])
    assert all(r[:3] == r[3:] for r in map(tuple, back.collect()))
    assert [tuple(r)[:3] for r in df.orderBy("p").collect()] == [tuple(r)[:3] for r in df.orderBy("n", "b", "t").collect()]


def test_dedup_with_types_that_have_no_text(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([None, "x", "X"]), rng.choice([None, "1", "2"]), rng.choice([None, True]),
             rng.choice([None, 0.5, -0.5]), rng.choice([None, 5, -5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string, c string, source_column_id string, b boolean, d double, n bigint")
    levels = {"column_id": ("s", "c")}
    keyed = S.rebuild_keys(df.withColumnRenamed("source_column_id", "column_id"), levels, stripped=True)
    found = S.dedup_best(keyed, fields=("c", "b", "d"), levels=levels)
    assert found.columns == keyed.columns and found.dtypes == keyed.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, S.dedup_best(keyed, fields=("c", "b", "d")).collect()))


def test_the_dedup_shuffles_a_path_and_one_text(spark):
    bronze = R.bronze_from_lineitem(spark, SF_SMALL)
    for df in (S.build_silver(bronze, stripped=True), S.dedup_best(S.prepare(bronze), levels=S.KEY_LEVELS)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        partial = next(x for x in plan.split("\n") if "partial_min" in x)
        assert "struct" not in partial and partial.rsplit("output=", 1)[-1].count(",") <= 1


def test_csv_files_are_packed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_FILE", 500)
    path = R.lineitem_csv(spark, SF_SMALL, f"{tmp_path}/csv")
    files = [f for f in (tmp_path / "csv").rglob("part-*")]
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert len(files) >= rows / 500 and all(f.name.endswith(".csv.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 100 * rows
    counts = R.csv_row_counts(spark, path).first()
    assert counts.good_rows + counts.corrupt_rows == rows
    whole = registry.QUERIES["csv_scan"](spark, SF_SMALL)
    assert sorted(map(repr, R.read_raw_csv(spark, path).select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))
