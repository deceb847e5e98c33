"""Sums and averages of doubles that do not depend on the order of the rows.

A double is a whole number of units of 2^(20 g): its digits to the base 2^20 at the places g are
integers below 2^20, taken by scaling, remainder and flooring, which is exact for doubles. Integer sums of
each digit are exact in any order and any partitioning, as an ordinary aggregate with BIGINT buffers
(partial, in codegen; a digit's sum holds 2^43 rows, beyond which ANSI mode raises). The digits
of the total, with carries, give the double nearest to the exact sum: the leading 80 bits and more
as an integer, whose last bit stands for all that follows.

``SPAN`` bounds the exponents for which digits are kept; a narrower one has fewer sums. A value outside
(also NaN and infinities) makes the result the plain sum.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 20
_MANTISSA = 53
_LEADING = 1 << 80  # digits are gathered until the number is at least so large


class Span(NamedTuple):
    """Non-zero values are in [2^low, 2^high) in size."""

    low: int
    high: int

    @property
    def places(self) -> range:
        return range((self.low - _MANTISSA) // BITS, -(-self.high // BITS))


# All of 100 * a / b, and of 100 minus it, for BIGINT a and b
RATIO = Span(-64, 72)
# what sums of large and small parts need in general
WIDE = Span(-220, 220)


def digits(col: str | Column, span: Span = RATIO) -> list[Column]:
    """The value's digits, lowest place first, as BIGINT with the value's sign; null values and those
    outside ``span`` have zeros."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    size = F.when(_inside(x, span), F.abs(x)).otherwise(F.lit(0.0))
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))
    base = F.lit(float(1 << BITS))
    # scaling by a power of two and the remainder are exact for doubles
    return [F.floor((size * F.lit(2.0 ** (-BITS * g))) % base) * sign for g in span.places]


def _inside(x: Column, span: Span) -> Column:
    """Is the value zero or within the span? Null for null."""
    size = F.abs(x)
    return (x == 0) | ((size >= F.lit(2.0 ** span.low)) & (size < F.lit(2.0 ** span.high)))


def sum_columns(col: str | Column, name: str, span: Span = RATIO) -> dict[str, Column]:
    """Aggregates by name that :func:`total` needs; each may be summed up further."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    sums = {f"__{name}_{i}": F.sum(d) for i, d in enumerate(digits(x, span))}
    outside = F.when(~_inside(x, span), x)
    return sums | {f"__{name}_n": F.count(x), f"__{name}_out": F.count(outside), f"__{name}_plain": F.sum(outside)}


def total(name: str, span: Span = RATIO) -> Column:
    """The sum from the columns that :func:`sum_columns` names; null without values."""
    return _total([F.col(f"__{name}_{i}") for i in range(len(span.places))], F.col(f"__{name}_n"), F.col(f"__{name}_out"),
                  F.col(f"__{name}_plain"), span)


def average(name: str, span: Span = RATIO) -> Column:
    return total(name, span) / F.nullif(F.col(f"__{name}_n"), F.lit(0))


def exact_sum(col: str | Column, span: Span = RATIO) -> Column:
    """Aggregate: the double nearest to the exact sum."""
    sums = list(sum_columns(col, "x", span).values())
    return _total(sums[:-3], *sums[-3:], span)


def exact_avg(col: str | Column, span: Span = RATIO) -> Column:
    """Aggregate: the exact sum, rounded to a double, by the count of values."""
    x = F.col(col) if isinstance(col, str) else col
    return exact_sum(x, span) / F.nullif(F.count(x), F.lit(0))


def _total(sums: list[Column], n: Column, outside: Column, plain: Column, span: Span) -> Column:
    carried = F.aggregate(F.array(*sums), _carry(F.lit(0), F.expr("array()").cast("array<bigint>")), _add)
    # a negative total: its opposite has the digits
    opposite = F.aggregate(F.transform(F.array(*sums), lambda d: -d), _carry(F.lit(0), F.expr("array()").cast("array<bigint>")), _add)
    both = F.array(F.struct(F.lit(1.0).alias("sign"), carried.alias("c")), F.struct(F.lit(-1.0).alias("sign"), opposite.alias("c")))
    right = F.filter(both, lambda b: b["c"]["carry"] >= 0)[0]
    exact = F.transform(F.array(right), lambda b: b["sign"] * _value(b["c"], span))[0]
    return F.when(n == 0, F.lit(None).cast("double")).when(outside == 0, exact).otherwise(
        plain + exact)


def _carry(carry: Column, done: Column) -> Column:
    return F.struct(carry.cast("bigint").alias("carry"), done.alias("digits"))


def _add(state: Column, digit: Column) -> Column:
    """One place up: digit in [0, 2^20), the rest carried (rounded down, also below zero)."""
    value = state["carry"] + digit
    return _carry(F.shiftright(value, BITS), F.concat(state["digits"], F.array(value.bitwiseAND((1 << BITS) - 1))))


def _value(carried: Column, span: Span) -> Column:
    """The number of a non-negative carry and its digits (lowest first), rounded once."""
    wide = "decimal(38,0)"
    start = F.struct(carried["carry"].cast(wide).alias("lead"), F.lit(0).alias("left"), F.lit(False).alias("more"))

    def take(state: Column, digit: Column) -> Column:
        full = state["lead"] >= F.lit(str(_LEADING)).cast(wide)
        longer = (state["lead"] * F.lit(1 << BITS).cast("decimal(8,0)")).cast(wide) + digit.cast("decimal(8,0)")
        return F.struct(F.when(full, state["lead"]).otherwise(longer.cast(wide)).alias("lead"),
                        F.when(full, state["left"] + 1).otherwise(state["left"]).alias("left"),
                        (state["more"] | (full & (digit != 0))).alias("more"))

    # lead < 2^101: one more bit says whether anything follows
    def finish(state: Column) -> Column:
        odd = (state["lead"] * F.lit(2).cast("decimal(1,0)")).cast(wide) + F.when(state["more"], 1).otherwise(0).cast("decimal(1,0)")
        return odd.cast(wide).cast("double") * F.pow(F.lit(2.0), (state["left"] + span.places.start) * BITS - 1)

    return F.aggregate(F.reverse(carried["digits"]), start, take, finish)
