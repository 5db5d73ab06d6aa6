"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.schemas import MONEY


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Column | str) -> Column:
    """Two-decimal money. Decimal sums do not depend on the order rows arrive in."""
    return col(value).cast(MONEY)


def as_double(value: Column | str) -> Column:
    return col(value).cast("double")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; null when the denominator is zero or null."""
    return as_double(numerator) / F.nullif(as_double(denominator), F.lit(0.0))


def mean(value: Column | str) -> Column:
    """Mean of the non-null values from an exact sum (``avg`` of a decimal rounds)."""
    return ratio(F.sum(value), F.count(value))


def total(value: Column | str) -> Column:
    """Sum as double."""
    return as_double(F.sum(value))


def total_or_zero(value: Column | str) -> Column:
    """Sum as double, zero on no rows."""
    return F.coalesce(total(value), F.lit(0.0))


def tally(condition: Column) -> Column:
    """How many rows satisfy the condition; zero on no rows."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def flag_sum(condition: Column) -> Column:
    """How many rows satisfy the condition; null on no rows."""
    return F.sum(F.when(condition, 1).otherwise(0))


def month_of(value: Column | str) -> Column:
    return F.trunc(col(value), "month")


def correlation(first: Column | str, second: Column | str) -> Column:
    """Pearson correlation over complete pairs; null where one side does not vary (``corr`` fails there)."""
    x, y = as_double(first), as_double(second)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def all_true(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_true(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns into a single row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def long_form(
    frame: DataFrame,
    columns: Sequence[str],
    *,
    keys: Sequence[str] = (),
    name: str = "metric",
    value: str = "value",
) -> DataFrame:
    """Unpivot numeric columns to (name, value) rows, values as double."""
    return frame.select(*keys, *[as_double(c).alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value
    )
