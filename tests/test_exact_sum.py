"""Sums of doubles: the nearest double to the exact sum, whatever the partitioning."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from govlens.functions.exact_sum import RATIO, WIDE, exact_avg, exact_sum, sum_columns, total


def exact(values):
    return float(sum(map(Fraction, values)))


@pytest.mark.parametrize("case", ["ratios", "cancelling", "negative", "wide", "tiny", "one"])
def test_sum_is_the_nearest_double(spark, case):
    r = random.Random(case)
    values = {
        "ratios": [100 * r.randrange(10**6) / r.randrange(1, 10**6) for _ in range(3000)],
        "cancelling": [s * r.random() * 2.0 ** r.randrange(-30, 60) for s in (1, -1) for _ in range(800)] + [1e-9],
        "negative": [-r.random() * 100 for _ in range(999)],
        "wide": [r.choice((1, -1)) * r.random() * 2.0 ** r.randrange(-219, 219) for _ in range(1500)],
        "tiny": [2.0 ** -64, 2.0 ** -64, 0.0, -0.0],
        "one": [1 / 3],
    }[case]
    span = WIDE if case == "wide" else RATIO
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {n: df.repartition(n).agg(exact_sum("x", span).alias("s"), exact_avg("x", span).alias("a")).first() for n in ((1, 7, 211) if case == "ratios" else (1, 3))}
    assert {(g.s, g.a) for g in got.values()} == {(exact(values), exact(values) / len(values))}


def test_ties_round_to_even(spark):
    for values in ([2.0 ** 53, 1.0], [2.0 ** 53, 1.0, 2.0 ** -40], [2.0 ** 53 + 2, 1.0], [-(2.0 ** 53), -1.0, -(2.0 ** -60)]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert df.agg(exact_sum("x")).first()[0] == exact(values)


def test_nulls_groups_and_values_outside(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", None), ("a", 0.2), ("b", None), ("c", math.nan), ("c", 1.0),
                                ("d", math.inf), ("d", 1.0), ("e", 1e300), ("e", 0.5)], "k string, x double")
    got = {r.k: (r.s, r.a) for r in df.groupBy("k").agg(exact_sum("x").alias("s"), exact_avg("x").alias("a")).collect()}
    assert got["a"] == (exact([0.1, 0.2]), exact([0.1, 0.2]) / 2) and got["b"] == (None, None)
    assert math.isnan(got["c"][0]) and got["d"] == (math.inf, math.inf) and got["e"][0] == 1e300
    assert df.limit(0).agg(exact_sum("x")).first()[0] is None


def test_sums_of_sums(spark):
    values = [(i % 5, i / 7) for i in range(1000)]
    df = spark.createDataFrame(values, "k int, x double")
    names = sum_columns("x", "s")
    parts = df.groupBy("k").agg(*[c.alias(n) for n, c in names.items()])
    whole = parts.agg(*[F.sum(n).alias(n) for n in names])
    assert whole.select(total("s")).first()[0] == exact([v for _, v in values])


def test_plan_is_one_hash_aggregate(spark):
    plan = spark.range(100).select((F.col("id") / 3).alias("x")).agg(exact_sum("x"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("HashAggregate") == 2
