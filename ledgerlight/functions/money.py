"""Exact money sums.

Adding doubles gives a result that depends on the order of the rows, and on a
cluster that order changes with every retry and every AQE re-plan.  Spend is
therefore summed as whole ten-millionths of a dollar in a BIGINT, which is
associative, stays inside whole-stage codegen, and is turned into a DOUBLE only
at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_DOLLAR = 10_000_000


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_units(amount: Column | str) -> Column:
    """Dollars to whole ten-millionths (half up)."""
    return F.floor(as_col(amount) * F.lit(float(UNITS_PER_DOLLAR)) + F.lit(0.5)).cast("bigint")


def from_units(units: Column | str) -> Column:
    return as_col(units).cast("double") / F.lit(float(UNITS_PER_DOLLAR))


def sum_money(amount: Column | str) -> Column:
    """Order-independent SUM of a dollar column; nulls count as zero."""
    return from_units(F.coalesce(F.sum(to_units(amount)), F.lit(0)))


def sum_count(value: Column | str) -> Column:
    """SUM of a counter where a null counter is zero."""
    return F.coalesce(F.sum(as_col(value).cast("bigint")), F.lit(0)).cast("bigint")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")
