"""Assistant quality monitoring over a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feedback_latest(log: DataFrame, clicks: DataFrame) -> DataFrame:
    """Apply feedback clicks to log entries: the last click per entry wins.

    Clicks are reduced per id with ``max_by`` (partial aggregation) before the
    join, so an entry clicked millions of times is still one row.
    """
    last = clicks.groupBy("id").agg(
        F.max_by("feedback", F.struct("click_ts", "feedback")).alias("clicked"))
    return (log.join(last, "id", "left")
            .withColumn("feedback", F.coalesce(F.col("clicked"), F.col("feedback")))
            .drop("clicked"))


def feedback_stats(log: DataFrame) -> DataFrame:
    """Totals, pending, average response time and shares (denominator >= 1).

    Rounding is half-to-even, like the dashboard's Python ``round``.
    """
    agg = log.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("feedback") == "helpful").alias("helpful"),
        F.count_if(F.col("feedback") == "not_helpful").alias("not_helpful"),
        F.coalesce(F.sum("response_time_s"), F.lit(0.0)).alias("_rt"),
    )
    den = F.greatest(F.col("total"), F.lit(1))
    return agg.select(
        "total", "helpful", "not_helpful",
        (F.col("total") - F.col("helpful") - F.col("not_helpful")).alias("pending"),
        F.bround(F.col("_rt") / den, 1).alias("avg_response_time_s"),
        F.bround(F.col("helpful") / den * 100, 0).cast("bigint").alias("helpful_pct"),
        F.bround(F.col("not_helpful") / den * 100, 0).cast("bigint").alias("not_helpful_pct"),
    )
