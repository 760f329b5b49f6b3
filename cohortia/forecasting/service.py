"""Forecasts for filtered slices, and the choice of where a forecast comes from."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.forecasting.arima import arima, sarima
from cohortia.forecasting.series import (
    FORECAST_PERIODS, FORECAST_SCHEMA, clamped, forecast_rows, to_series, with_models,
)
from cohortia.forecasting.smoothing import lstm_proxy
from cohortia.functions.years import start_year
from cohortia.operators.enrolment import (
    NO_FILTERS, forecast_history, provider_history, ssa_history,
)
from cohortia.operators.filters import FilterSet
from cohortia.sources.files import open_if_present, saved_forecast, stored_forecasts
from cohortia.sources.star import Star

DEFAULT_MODEL = "sarima"
MODELS = {"arima": arima, "sarima": sarima, "lstm": lstm_proxy}
SHORTEST_HISTORY = 2


def model_named(name: str | None):
    """Label and function of a model; an unknown name runs the default one."""
    key = str(name or DEFAULT_MODEL).lower()
    return key.upper(), MODELS.get(key, MODELS[DEFAULT_MODEL])


def as_forecast(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(field.name).cast(field.dataType) for field in FORECAST_SCHEMA])


def provider_forecast(star: Star, model: str | None = None, filters: FilterSet = NO_FILTERS,
                      periods: int = FORECAST_PERIODS) -> DataFrame:
    """Forecast of one filtered slice; no rows below two years of history."""
    label, run = model_named(model)
    series = to_series(forecast_history(star, filters), []).where(F.size("y") >= SHORTEST_HISTORY)
    done = run(series, periods).withColumn("steps", clamped(F.col("steps")))
    rows = forecast_rows(done, [], label)
    return as_forecast(rows.withColumn("provider_key", F.lit(filters.provider_id).cast("bigint")))


def all_provider_forecasts(star: Star, model: str | None = None, filters: FilterSet = NO_FILTERS,
                           periods: int = FORECAST_PERIODS) -> DataFrame:
    """The same for every provider in one job."""
    series = to_series(provider_history(star, filters), ["provider_skey"])
    return forecast_series(series, model, periods)


def forecast_series(series: DataFrame, model: str | None = None, periods: int = FORECAST_PERIODS) -> DataFrame:
    """Forecast rows of provider series that are already built."""
    label, run = model_named(model)
    long_enough = series.where(F.size("y") >= SHORTEST_HISTORY)
    done = run(long_enough, periods).withColumn("steps", clamped(F.col("steps")))
    rows = forecast_rows(done, ["provider_skey"], label)
    return as_forecast(rows.withColumnRenamed("provider_skey", "provider_key"))


def ssa_forecast(star: Star, model: str | None = None, filters: FilterSet = NO_FILTERS,
                 periods: int = FORECAST_PERIODS) -> DataFrame:
    """One forecast per subject area, all labelled from the last year of any of them."""
    label, run = model_named(model)
    series = to_series(ssa_history(star, filters), ["ssa_tier1"])
    newest = series.agg(F.max(F.element_at("years", -1)).alias("last_of_all")).scalar()
    done = run(series, periods).withColumn("steps", clamped(F.col("steps")))
    return forecast_rows(done, ["ssa_tier1"], label, last_year=newest).drop("year")


def saved_or_filtered_ssa_forecast(star: Star, path: str, model: str | None = None,
                                   filters: FilterSet = NO_FILTERS) -> DataFrame:
    """The saved subject-area forecast, or a fresh one when a town or year is asked."""
    if filters.location is not None or filters.years != (None, None):
        return ssa_forecast(star, model, replace(NO_FILTERS, location=filters.location,
                                                 start_year=filters.start_year, end_year=filters.end_year))
    saved = open_if_present(star.spark, f"{path}/{model_named(model)[0].lower()}_ssa_forecast")
    if saved is None:
        return star.spark.createDataFrame(
            [], "ssa_tier1 string, academic_year string, predicted_enrolments double, lower_ci double, "
                "upper_ci double, model_type string")
    return saved.select("ssa_tier1", "academic_year", "predicted_enrolments", "lower_ci", "upper_ci", "model_type")


def resolve_forecast(star: Star, model: str | None = None, filters: FilterSet = NO_FILTERS,
                     store: str | None = None, saved: str | None = None,
                     latest_only: bool = False) -> DataFrame:
    """Filtered slices are computed; else the store, a saved file, or a computed provider.

    Each source is probed with ``isEmpty`` only, which stops at the first row.
    """
    if not filters.only_provider():
        return provider_forecast(star, model, filters)
    label, _ = model_named(model)
    spark = star.spark
    if store is not None:
        rows = stored_forecasts(spark, store, label, filters.provider_id, latest_only)
        if rows is not None and not rows.isEmpty():
            return as_forecast(rows.withColumn("year", start_year(F.col("academic_year"))))
    if saved is not None:
        rows = saved_forecast(spark, f"{saved}/{label.lower()}_forecast", filters.provider_id)
        if rows is not None and not rows.isEmpty():
            return rows
    if filters.provider_id is not None:
        return provider_forecast(star, model, filters)
    return spark.createDataFrame([], FORECAST_SCHEMA)


def history_with_forecast(star: Star, model: str | None = None, filters: FilterSet = NO_FILTERS,
                          store: str | None = None, saved: str | None = None) -> DataFrame:
    """History and forecast of a slice in one frame, tagged; intervals only on the forecast."""
    label, _ = model_named(model)
    forecast = resolve_forecast(star, model, filters, store, saved)
    history = forecast_history(star, filters).select(
        "academic_year", F.col("learner_count").cast("double").alias("learner_count"),
        F.lit("Historical").alias("data_type"))
    future = forecast.select(
        "academic_year", F.col("predicted_enrolments").alias("learner_count"),
        F.lit("Forecast").alias("data_type"), "lower_ci", "upper_ci", F.lit(label).alias("model_type"))
    return history.unionByName(future, allowMissingColumns=True)


def in_display_order(combined: DataFrame) -> DataFrame:
    """By start year, history before forecast."""
    kind = F.when(F.col("data_type") == "Historical", 0).otherwise(1)
    return combined.orderBy(start_year(F.col("academic_year")), kind)


def compare_models(star: Star, filters: FilterSet = NO_FILTERS, periods: int = FORECAST_PERIODS,
                   store: str | None = None, saved: str | None = None) -> DataFrame:
    """All models on one slice, below each other; a model without rows adds none.

    Where stored forecasts may serve, each model is looked up. Else the history
    is aggregated once, and every model reads the same series row.
    """
    if filters.only_provider() and (store or saved or filters.provider_id is None):
        found = [resolve_forecast(star, name, filters, store, saved) for name in MODELS]
        return found[0].unionByName(found[1]).unionByName(found[2])
    series = to_series(forecast_history(star, filters), []).where(F.size("y") >= SHORTEST_HISTORY)
    spread = with_models(series, ["years"], MODELS, periods).withColumn("steps", clamped(F.col("steps")))
    rows = forecast_rows(spread, ["model"], "").drop("model_type").withColumnRenamed("model", "model_type")
    return as_forecast(rows.withColumn("provider_key", F.lit(filters.provider_id).cast("bigint")))
