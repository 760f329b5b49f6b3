"""Closed-form forecasts: naive, smoothing, trend and averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.forecasting.series import FORECAST_PERIODS, let, mean, population_std, step
from cohortia.functions.numbers import percent_change

# Fixed values of the forecasts.
NAIVE_Z, PROXY_Z = 1.96, 1.64
PROXY_ALPHA, PROXY_LOOKBACK = 0.35, 4
SAVED_ALPHA, SAVED_MARGIN = 0.3, 0.15
SMOOTH_ALPHA = 0.3
HOLT_ALPHA, HOLT_BETA = 0.3, 0.1
AVERAGE_WINDOW = 3


def last(y: Column) -> Column:
    return F.try_element_at(y, F.lit(-1))


def first(y: Column) -> Column:
    return F.try_element_at(y, F.lit(1))


def rest(y: Column) -> Column:
    return F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0)))


def horizon(periods: int) -> Column:
    return F.sequence(F.lit(1), F.lit(periods))


def usable_spread(spread: Column, level: Column) -> Column:
    """The spread, or a tenth of the level (at least 1) where it says nothing."""
    tenth = F.greatest(F.abs(level) * 0.1, F.lit(1.0))
    bad = spread.isNull() | F.isnan(spread) | (spread == 0) | (F.abs(spread) == float("inf"))
    return F.when(bad, tenth).otherwise(spread)


def naive_steps(y: Column, periods: int) -> Column:
    spread = F.when(F.size(y) > 1, population_std(y))
    level = last(y)
    some = let(usable_spread(spread, level) * NAIVE_Z, lambda margin: step(level, level - margin, level + margin))
    nothing = step(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.array_repeat(F.when(F.size(y) > 0, some).otherwise(nothing), periods)


def smooth(y: Column, alpha: float) -> Column:
    """Simple exponential smoothing, one value per point."""
    return F.aggregate(
        rest(y), F.slice(y, 1, 1),
        lambda acc, x: F.concat(acc, F.array(alpha * x + (1 - alpha) * F.element_at(acc, -1))))


def holt(y: Column, alpha: float = HOLT_ALPHA, beta: float = HOLT_BETA) -> Column:
    """Level and trend at every point; needs two points."""
    def state(level: Column, trend: Column) -> Column:
        return F.struct(level.alias("level"), trend.alias("trend"))

    def move(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)
        level = alpha * x + (1 - alpha) * (before["level"] + before["trend"])
        trend = beta * (level - before["level"]) + (1 - beta) * before["trend"]
        return F.concat(acc, F.array(state(level, trend)))

    start = F.array(state(first(y), F.try_element_at(y, F.lit(2)) - first(y)))
    return F.aggregate(rest(y), start, move)


# -- models: a series frame in, the same frame with ``steps`` out -------------

def naive(series: DataFrame, periods: int = FORECAST_PERIODS) -> DataFrame:
    return series.withColumn("steps", naive_steps(F.col("y"), periods))


def lstm_proxy(series: DataFrame, periods: int = FORECAST_PERIODS) -> DataFrame:
    """Smoothed level plus recent trend, with the spread of the smoothing errors."""
    y = F.col("y")
    lookback = F.least(F.lit(PROXY_LOOKBACK), F.size(y) - 1)
    trend = F.coalesce(
        F.try_divide(last(y) - F.try_element_at(y, F.size(y) - lookback), lookback.cast("double")), F.lit(0.0))

    def steps(smoothed: Column) -> Column:
        level = last(smoothed)
        errors = F.zip_with(y, smoothed, lambda a, b: a - b)
        spread = usable_spread(F.when(F.size(y) > 1, population_std(errors)), level)
        return let(F.struct(level.alias("level"), trend.alias("trend"), (spread * PROXY_Z).alias("margin")),
                   lambda s: F.transform(horizon(periods), lambda h: let(
                       s["level"] + s["trend"] * h,
                       lambda p: step(p, p - s["margin"], p + s["margin"]))))

    return series.withColumn("steps", let(smooth(y, PROXY_ALPHA), steps))


def lstm_saved(series: DataFrame, periods: int = FORECAST_PERIODS) -> DataFrame:
    """The variant stored by training: whole-range trend and a margin in percent."""
    y = F.col("y")
    trend = F.coalesce(F.try_divide(last(y) - first(y), (F.size(y) - 1).cast("double")), F.lit(0.0))
    level = last(smooth(y, SAVED_ALPHA))
    pair = F.struct(level.alias("level"), trend.alias("trend"))
    return series.withColumn("steps", let(pair, lambda s: F.transform(horizon(periods), lambda h: let(
        s["level"] + s["trend"] * h,
        lambda p: step(p, p * (1 - SAVED_MARGIN), p * (1 + SAVED_MARGIN))))))


# -- plain value forecasts ----------------------------------------------------

def value_forecast(series: DataFrame, keys: list[str], method: str = "holt",
                   periods: int = FORECAST_PERIODS, target: str = "learner_count") -> DataFrame:
    """``holt``, ``ema`` or (anything else) moving average, as (key, year, value) rows."""
    y = F.col("y")
    if method == "holt":
        series = series.where(F.size(y) > 1)
        values = let(F.element_at(holt(y), -1), lambda s: F.transform(
            horizon(periods), lambda h: s["level"] + s["trend"] * h))
    elif method == "ema":
        def extrapolate(smoothed: Column) -> Column:
            slope = F.try_divide(last(smoothed) - first(smoothed), (F.size(smoothed) - 1).cast("double"))
            return let(F.struct(last(smoothed).alias("level"), slope.alias("trend")), lambda s: F.transform(
                horizon(periods), lambda h: s["level"] + s["trend"] * h))
        values = let(smooth(y, SMOOTH_ALPHA), extrapolate)
    else:
        window = F.slice(y, F.size(y) - AVERAGE_WINDOW + 1, AVERAGE_WINDOW)
        average = F.when(F.size(y) >= AVERAGE_WINDOW, mean(window))
        values = F.array_repeat(average, periods)
    rows = series.select(*keys, F.element_at("years", -1).alias("last_year"),
                         F.posexplode_outer(values).alias("place", "value"))
    return rows.select(
        *keys, (F.col("last_year") + F.col("place") + 1).cast("int").alias("year"),
        F.col("value").alias(f"forecast_{target}"))


def smoothed_rows(series: DataFrame, keys: list[str], alpha: float = SMOOTH_ALPHA) -> DataFrame:
    points = F.arrays_zip("years", "y", smooth(F.col("y"), alpha).alias("smoothed"))
    return series.select(*keys, F.inline_outer(points)).withColumnsRenamed({"years": "year", "y": "value"})


def holt_rows(series: DataFrame, keys: list[str]) -> DataFrame:
    """Level and trend at every point of each series."""
    states = series.where(F.size("y") > 1).withColumn("states", holt(F.col("y")))
    points = F.arrays_zip("years", F.col("states.level").alias("level"), F.col("states.trend").alias("trend"))
    return states.select(*keys, F.inline_outer(points)).withColumnRenamed("years", "year")


def linear_trend(history: DataFrame, keys: list[str], periods: int = FORECAST_PERIODS,
                 target: str = "learner_count") -> DataFrame:
    """Least-squares line through the yearly sums, and the growth of the last year."""
    yearly = history.groupBy(*keys, "year").agg(F.sum(target).cast("double").alias("v"))
    year = F.col("year").cast("double")
    fitted = yearly.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("v", year), F.lit(0.0)).alias("slope"),
        F.avg(year).alias("mid_year"), F.avg("v").alias("mid_value"),
        F.max("year").alias("last_year"),
        F.array_sort(F.collect_list(F.struct("year", "v"))).alias("points"))
    now = F.try_element_at("points", F.lit(-1))["v"]
    before = F.try_element_at("points", F.lit(-2))["v"]
    rows = fitted.select(
        "*", F.coalesce(percent_change(now, before, 2), F.lit(0.0)).alias("growth_rate"),
        F.explode(horizon(periods)).alias("h"))
    future = F.col("last_year") + F.col("h")
    return rows.select(
        *keys, future.cast("int").alias("year"),
        (F.col("mid_value") + F.col("slope") * (future - F.col("mid_year"))).alias(f"predicted_{target}"),
        "growth_rate", F.lit("Forecast").alias("trend"))
