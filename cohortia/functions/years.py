"""Academic-year labels such as ``23/24`` or ``2023/24``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def start_year(label: Column) -> Column:
    """Start year of a label; two digits mean 20xx, text without a number gives NULL."""
    head = F.trim(F.split_part(F.trim(label), F.lit("/"), F.lit(1)))
    number = F.when(head.rlike("^[0-9]+$"), head.try_cast("int"))
    return F.when(F.length(head) == 2, number + 2000).otherwise(number)


def start_year_key(label: Column) -> Column:
    """Start year used in predicates: any number below 100 means 20xx.

    Differs from :func:`start_year` only for short numbers that are not two
    digits long, such as ``7/8``.
    """
    number = F.split_part(label, F.lit("/"), F.lit(1)).try_cast("int")
    return F.when(number < 100, number + 2000).otherwise(number)


def two_digit_key(label: Column) -> Column:
    """First two characters as a number; meant for ``YY/YY`` labels."""
    return F.substring(label, 1, 2).try_cast("int")


def year_label(year: Column) -> Column:
    """``2026`` -> ``26/27``."""
    def tail(value: Column) -> Column:
        return F.right(value.cast("string"), F.lit(2))

    return F.concat(tail(year), F.lit("/"), tail(year + 1))
