"""Annual series, one row per key, and the way back to forecast rows.

A series is two arrays, ``years`` and ``y``, with one element per academic
year. Facts are aggregated to (key, year) before they are collected, so an
array is as long as there are years, however many facts a key has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from cohortia.functions.numbers import not_below
from cohortia.functions.years import year_label
from cohortia.session import shuffle_width

FORECAST_PERIODS = 3

FORECAST_SCHEMA = StructType([
    StructField("academic_year", StringType()),
    StructField("year", IntegerType()),
    StructField("predicted_enrolments", DoubleType()),
    StructField("lower_ci", DoubleType()),
    StructField("upper_ci", DoubleType()),
    StructField("model_type", StringType()),
    StructField("provider_key", LongType()),
])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def to_series(history: DataFrame, keys: list[str], value: str = "learner_count") -> DataFrame:
    """Collect (key, year, value) rows to one row per key.

    The rows are few but the models on top are not cheap, so the keys are
    spread over the session's shuffle partitions: the count is fixed, else adaptive execution would
    merge so little data into one task. The grouping uses the same exchange.
    """
    if keys:
        history = history.repartition(shuffle_width(history.sparkSession), *keys)
    point = F.struct(F.col("year").cast("int").alias("year"), F.col(value).cast("double").alias("value"))
    points = F.array_sort(F.collect_list(point)).alias("points")
    series = history.groupBy(*keys).agg(points).where(F.size("points") > 0)
    return series.select(
        *keys, F.col("points.year").alias("years"), F.col("points.value").alias("y"))


def total(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda acc, x: acc + x)


def mean(y: Column) -> Column:
    return F.try_divide(total(y), F.size(y))


def population_std(y: Column) -> Column:
    return let(mean(y), lambda m: F.sqrt(
        F.aggregate(y, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(y)))


def step(predicted: Column, lower: Column, upper: Column) -> Column:
    return F.struct(
        predicted.cast("double").alias("predicted"), lower.cast("double").alias("lower"),
        upper.cast("double").alias("upper"))


def clamped(steps: Column) -> Column:
    """No negative predictions or lower bounds, and no upper bound below the prediction."""
    zero = F.lit(0.0)

    def one(s: Column) -> Column:
        predicted = not_below(s["predicted"], zero)
        return step(predicted, not_below(s["lower"], zero), not_below(s["upper"], predicted))

    return F.transform(steps, one)


def forecast_rows(forecast: DataFrame, keys: list[str], model_type: str,
                  last_year: Column | None = None) -> DataFrame:
    """One row per key and future year from a ``steps`` column.

    The outer form of the generator is used here and in the modules beside:
    from the plain one Spark derives a filter on the array, which would work
    out every forecast again below the projection.
    """
    last = F.element_at("years", -1) if last_year is None else last_year
    rows = forecast.select(*keys, last.alias("last_year"), F.posexplode_outer("steps").alias("place", "s"))
    year = (F.col("last_year") + F.col("place") + 1).cast("int")
    return rows.select(
        *keys,
        year_label(year).alias("academic_year"),
        year.alias("year"),
        F.col("s.predicted").alias("predicted_enrolments"),
        F.col("s.lower").alias("lower_ci"),
        F.col("s.upper").alias("upper_ci"),
        F.lit(model_type).alias("model_type"),
    )


def with_models(series: DataFrame, keep: list[str], models: dict[str, Callable], periods: int) -> DataFrame:
    """One row per series and model, with the model's name and its ``steps``.

    All models read the series row they find, so the series is built once.
    """
    for name, run in models.items():
        series = run(series, periods).withColumnRenamed("steps", f"steps_{name}").drop("fit")
    by_model = F.array(*[
        F.struct(F.lit(name.upper()).alias("model"), F.col(f"steps_{name}").alias("steps")) for name in models])
    return series.select(*keep, F.inline_outer(by_model))
