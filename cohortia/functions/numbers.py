"""Numeric helpers that never raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def contribution(income: Column, costs: Column) -> Column:
    """``(income - costs) / income``; NULL when there is no income."""
    return F.try_divide((income - costs).cast("double"), income.cast("double"))


def percent_change(now: Column, before: Column, digits: int) -> Column:
    """Change in percent, rounded half to even."""
    ratio = F.try_divide((now - before).cast("double") * 100, before.cast("double"))
    return F.bround(ratio, digits)


def round_share(part: Column, whole: Column, digits: int) -> Column:
    return F.bround(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def not_below(value: Column, floor: Column) -> Column:
    """NULL-safe lower clamp: NULL stays NULL."""
    return F.when(value < floor, floor).otherwise(value)


def nulls_for_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}

    def clean(name: str) -> Column:
        column = F.col(f"`{name}`")
        if name not in floating:
            return column
        bad = F.isnan(column) | (F.abs(column) == float("inf"))
        return F.when(~bad, column).alias(name)

    return df.select(*[clean(name) for name in df.columns])
