"""How good a forecast is: in-sample errors and hold-out tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.forecasting.arima import differences, with_fit
from cohortia.forecasting.series import FORECAST_PERIODS, let, mean, with_models


def error_measures(errors: Column, actuals: Column) -> dict[str, Column]:
    """MAE, RMSE and MAPE; points with actual 0 do not count in the last one."""
    shares = F.zip_with(errors, actuals, lambda e, a: F.abs(F.try_divide(e, a)))
    known = F.filter(shares, lambda s: s.isNotNull())
    return {
        "mae": mean(F.transform(errors, F.abs)),
        "rmse": F.sqrt(mean(F.transform(errors, lambda e: e * e))),
        "mape": mean(known) * 100,
    }


def residuals(f: Column, y: Column, w: Column) -> Column:
    """One-step errors of a fit, aligned with the last points of the series."""
    def chained(values: Column, drop: int) -> Column:
        # e_t = w_t - phi w_{t-1} - theta e_{t-1}, zero before the first counted one
        def move(acc: Column, i: Column) -> Column:
            before = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
            lagged = F.coalesce(F.try_element_at(values, F.greatest(i - 1, F.lit(1))), F.lit(0.0))
            return F.concat(acc, F.array(F.element_at(values, i) - f["phi"] * lagged - f["theta"] * before))
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))), lambda i: i > drop)
        return F.aggregate(places, F.array().cast("array<double>"), move)

    count = F.greatest(F.size(y) - 1, F.lit(0))
    regression = F.zip_with(F.slice(y, 2, count), F.slice(y, 1, count),
                            lambda now, before: now - f["const"] - f["phi"] * before)
    return (
        F.when(f["order"] == "111", let(w, lambda v: chained(v, 1)))
        .when(f["order"] == "011", let(w, lambda v: chained(v, 0)))
        .when(f["order"] == "100", regression)
        .otherwise(F.transform(y, lambda x: x - f["const"])))


def training_metrics(series: DataFrame, keys: list[str], model: str,
                     periods: int = FORECAST_PERIODS) -> DataFrame:
    """In-sample MAE, RMSE and MAPE with run metadata; none for the smoothing model."""
    y = F.col("y")
    meta = [
        F.lit(model.upper()).alias("model"),
        F.size(y).cast("bigint").alias("data_points"),
        F.lit(periods).cast("bigint").alias("forecast_periods"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("last_trained"),
    ]
    if model == "lstm":
        nothing = F.lit(None).cast("double")
        return series.select(
            *keys, F.lit(None).cast("string").alias("order"),
            *[nothing.alias(name) for name in ("mae", "rmse", "mape")], *meta)
    fitted = with_fit(series, seasonal=model == "sarima")
    fitted = fitted.withColumn("errors", residuals(F.col("fit"), y, differences(y)))
    actuals = F.slice(y, F.size(y) - F.size("errors") + 1, F.size("errors"))
    measures = error_measures(F.col("errors"), actuals)
    measured = F.struct(
        F.col("fit.order").alias("order"),
        *[F.round(value, 2).alias(name) for name, value in measures.items()], *meta)
    rows = fitted.select(*keys, F.inline_outer(F.array(F.when(F.col("fit").isNotNull(), measured))))
    return rows.where(F.col("order").isNotNull())


def backtest(series: DataFrame, keys: list[str], models: dict[str, Callable], hold_out: int = 2) -> DataFrame:
    """Forecast the last points from the points before them, per key and model."""
    y, n = F.col("y"), F.size("y")
    split = series.where(n > hold_out).select(
        *keys, "years", F.slice(y, 1, n - hold_out).alias("y"),
        F.slice(y, n - hold_out + 1, hold_out).alias("actual"))
    errors = F.zip_with("actual", "steps.predicted", lambda a, p: a - p)
    measures = error_measures(errors, F.col("actual"))
    return with_models(split, [*keys, "actual"], models, hold_out).select(
        *keys, F.col("model").alias("model_type"),
        *[value.alias(measure) for measure, value in measures.items()])
