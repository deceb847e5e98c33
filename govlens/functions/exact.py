"""Rounded averages computed from integer sums, so the result is the exact
half-up rounding and never depends on partitioning or summation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_div(num: Column, den: Column) -> Column:
    """round_half_up(num / den) for integer num and positive integer den, as a double.

    Evaluated as (2|num| + den) div (2 den) on DECIMAL(38,0): no floating point before
    the quotient, and no overflow for any BIGINT operands.
    """
    wide = [c.cast("decimal(19,0)") for c in (F.abs(num), den)]
    q = F.call_function("div", wide[0] * 2 + wide[1], wide[1] * 2).cast("double")
    return F.when(den > 0, F.when(num < 0, -q).otherwise(q))


def scaled_sum(col: str | Column, scale: int) -> Column:
    """Sum of a column holding values with ``scale`` decimals, as an integer."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(F.round(c * (10 ** scale)).cast("bigint"))


def avg_round(col: str | Column, scale: int, digits: int, name: str) -> tuple[list[Column], Column]:
    """(aggregates, final expression) for round(avg(col), digits) where every
    value has at most ``scale`` decimals (digits >= scale)."""
    c = F.col(col) if isinstance(col, str) else col
    s, n = f"__s_{name}", f"__n_{name}"
    aggs = [scaled_sum(c, scale).alias(s), F.count(c).alias(n)]
    num = F.col(s) * (10 ** (digits - scale))
    return aggs, (half_up_div(num, F.col(n)) / (10 ** digits)).alias(name)


def completeness_avg_round(digits: int, name: str) -> tuple[list[Column], Column]:
    """round(avg(checks_passed / checks_total * 100), digits), exactly."""
    s, n, t = f"__s_{name}", f"__n_{name}", f"__t_{name}"
    aggs = [F.sum("checks_passed").cast("bigint").alias(s), F.count("checks_passed").alias(n),
            F.max("checks_total").alias(t)]
    num = F.col(s) * (100 * 10 ** digits)
    return aggs, (half_up_div(num, F.col(n) * F.col(t)) / (10 ** digits)).alias(name)


def finish(df, finals: list[Column], order: list[str]):
    """Apply final expressions and keep ``order`` (drops the helper sums)."""
    out = df.select("*", *finals)
    return out.select(*order)
