"""Second-level summaries, windows and reshapes over yearly aggregates.

Windows without a partition key appear only here, over one row per year.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.numbers import percent_change, round_share
from cohortia.functions.years import start_year
from cohortia.session import stored


# Columns that reports are sorted by, as far as a frame has them.
REPORT_ORDER = (
    "academic_year", "provider_name", "ssa_tier1", "ssa_tier2", "age_group", "level_desc",
    "funding_scheme", "location", "provider_skey",
)
SSA_PREVIEW, PROVIDER_PREVIEW = 50, 100


def in_report_order(df: DataFrame) -> DataFrame:
    """Sorted for display, missing values last. For the edge only: it sorts all rows."""
    return df.orderBy(*[F.col(name).asc_nulls_last() for name in REPORT_ORDER if name in df.columns])


def preview(df: DataFrame, rows: int) -> DataFrame:
    """The first rows in report order; a small top-k, not a sort of everything."""
    return in_report_order(df).limit(rows)


def enrolment_summary(df: DataFrame) -> DataFrame:
    """Sums per year with the change against the year before in percent."""
    sums = [F.sum(name).alias(name) for name in ("learner_count", "enrolment_count") if name in df.columns]
    yearly = df.groupBy("academic_year").agg(*sums)
    before = F.lag("learner_count").over(Window.orderBy("academic_year"))
    return yearly.withColumn("yoy_change", percent_change(F.col("learner_count"), before, 2))


def trend_direction(trends: DataFrame) -> DataFrame:
    """Change of learners against the year before and its direction."""
    before = F.lag("total_learners").over(Window.orderBy("academic_year"))
    changed = trends.withColumn("change", percent_change(F.col("total_learners"), before, 1))
    direction = (
        F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down")
        .when(F.col("change") == 0, "flat").otherwise("none"))
    return changed.withColumn("direction", direction)


def ssa_breakdown(df: DataFrame) -> DataFrame:
    """Learners per year and subject area with the share of the year's total."""
    parts = df.groupBy("academic_year", "ssa_tier1").agg(F.sum("learner_count").alias("learner_count"))
    whole = F.sum("learner_count").over(Window.partitionBy("academic_year"))
    return parts.withColumn("percentage", round_share(F.col("learner_count"), whole, 2))


def kpi_metrics(df: DataFrame, current_year: str | None = None) -> DataFrame:
    """Total, current year, mean per year, and the year with most learners.

    The earliest label wins a tie for the peak.
    """
    yearly = df.groupBy("academic_year").agg(F.sum("learner_count").alias("n"))
    peak = F.min_by("academic_year", F.struct(-F.col("n"), F.col("academic_year")))
    if current_year is None:
        current = F.max_by("n", "academic_year")
    else:
        current = F.sum(F.when(F.col("academic_year") == current_year, F.col("n")))
    return yearly.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_learners"),
        F.coalesce(current, F.lit(0)).alias("current_year_learners"),
        F.avg("n").alias("average_per_year"),
        F.coalesce(peak, F.lit("N/A")).alias("peak_year"),
    )


def latest_year_rows(df: DataFrame) -> DataFrame:
    """Rows of the greatest year label. The figures are stored first, so what they come from is read once."""
    rows = stored(df, "yearly")
    latest = rows.select(F.max("academic_year").alias("latest"))
    return rows.where(F.col("academic_year") == latest.scalar())


def prepare_series(df: DataFrame, target: str, date: str = "year", groups: Iterable[str] = ()) -> DataFrame:
    return df.groupBy(*groups, date).agg(F.sum(target).alias(target))


def lag_features(df: DataFrame, target: str, groups: list[str], lags: Iterable[int] = (1, 2, 3)) -> DataFrame:
    """Lags, rolling mean and rolling deviation in year order within a group."""
    ordered = Window.partitionBy(*groups).orderBy("year")
    last_three = ordered.rowsBetween(-2, 0)
    columns = {f"{target}_lag_{k}": F.lag(target, k).over(ordered) for k in lags}
    columns[f"{target}_rolling_mean_3"] = F.avg(target).over(last_three)
    columns[f"{target}_rolling_std_3"] = F.stddev_samp(target).over(last_three)
    return df.withColumns(columns)


def moving_average(df: DataFrame, target: str, groups: list[str], window: int = 3) -> DataFrame:
    """Mean of the last rows, NULL until there are enough of them."""
    frame = Window.partitionBy(*groups).orderBy("year").rowsBetween(-(window - 1), 0)
    full = F.count(target).over(frame) == window
    return df.withColumn("moving_average", F.when(full, F.avg(target).over(frame)))


def time_features(df: DataFrame, year_column: str = "academic_year") -> DataFrame:
    """Start year and, where there is a month, quarter and position in the year."""
    out = df.withColumn("year", start_year(F.col(year_column)))
    if "month" not in df.columns:
        return out
    month = F.col("month").cast("int")
    angle = F.lit(2) * F.pi() * month / 12
    return out.withColumns({
        "month_num": month,
        "quarter_num": F.floor((month - 1) / 3).cast("int") + 1,
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    })


def sequence_windows(
    df: DataFrame, features: list[str], target: str, groups: list[str], length: int = 3
) -> DataFrame:
    """Scaled training windows: the ``length`` rows before a row and its target.

    Every column is scaled to 0..1 over the whole frame first; a constant
    column becomes 0. Rows without a full window before them are left out.
    """
    scaled = scale_minmax(df, list(dict.fromkeys([target, *features])))
    ordered = Window.partitionBy(*groups).orderBy("year")
    columns: list[Column] = []
    for name in features:
        for back in range(length, 0, -1):
            columns.append(F.lag(name, back).over(ordered).alias(f"x_{name}_{length - back + 1}"))
    rows = scaled.select(
        *groups, "year", *columns, F.col(target).alias("y"), F.row_number().over(ordered).alias("position"))
    return rows.where(F.col("position") > length).drop("position")


def scale_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """To 0..1; a constant column becomes 0."""
    limits = df.agg(F.struct(*[f(name).cast("double").alias(f"{name}_{tag}") for name in columns
                               for f, tag in ((F.min, "lo"), (F.max, "hi"))]).alias("limits")).scalar()

    def scaled(name: str) -> Column:
        low, high = limits[f"{name}_lo"], limits[f"{name}_hi"]
        value = F.col(name).cast("double")
        return F.when(high == low, value - low).otherwise((value - low) / (high - low)).alias(name)

    return df.select(*[scaled(n) if n in columns else F.col(n) for n in df.columns])


def scale_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """To mean 0 and population deviation 1; a constant column becomes 0."""
    limits = df.agg(F.struct(*[
        f(F.col(name).cast("double")).alias(f"{name}_{tag}") for name in columns
        for f, tag in ((F.avg, "mean"), (F.stddev_pop, "std"))]).alias("limits")).scalar()

    def scaled(name: str) -> Column:
        centred, spread = F.col(name).cast("double") - limits[f"{name}_mean"], limits[f"{name}_std"]
        return F.when(spread == 0, centred).otherwise(centred / spread).alias(name)

    return df.select(*[scaled(n) if n in columns else F.col(n) for n in df.columns])


def date_dimension(bounds: DataFrame) -> DataFrame:
    """One row per month from January of ``first`` to December of ``last``.

    The academic year starts in August; the flag marks September.
    """
    month = (
        bounds.select(F.explode(F.sequence(
            F.make_date(F.year("first"), F.lit(1), F.lit(1)),
            F.make_date(F.year("last"), F.lit(12), F.lit(1)),
            F.expr("interval 1 month"))).alias("day"))
    )
    day = F.col("day")
    year, number = F.year(day), F.month(day)
    start = F.when(number >= 8, year).otherwise(year - 1)
    return month.select(
        (year * 100 + number).alias("date_key"),
        year.alias("year"),
        number.alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.concat(F.lit("Q"), F.quarter(day)).alias("quarter_name"),
        F.concat(start, F.lit("/"), F.right((start + 1).cast("string"), F.lit(2))).alias("academic_year"),
        F.when(number == 9, 1).otherwise(0).alias("is_academic_start"),
    )


def pivot_years(forecast: DataFrame, years: list[str]) -> DataFrame:
    """Subject areas by forecast year, missing cells 0, rounded half to even.

    Listing the years keeps the pivot to a single aggregation.
    """
    table = forecast.groupBy(F.col("ssa_tier1").alias("subject_area")).pivot("academic_year", years).agg(
        F.sum("predicted_enrolments"))
    cells = [F.rint(F.coalesce(F.col(f"`{y}`"), F.lit(0.0))).cast("bigint").alias(y) for y in years]
    return table.select("subject_area", *cells)


def year_map(forecast: DataFrame) -> DataFrame:
    """Per subject area a map of year label to prediction, a few years each."""
    pairs = F.array_sort(F.collect_list(F.struct("academic_year", "predicted_enrolments")))
    return forecast.groupBy("ssa_tier1").agg(F.map_from_entries(pairs).alias("predictions"))


def combine_for_export(history: DataFrame, forecast: DataFrame, target: str) -> DataFrame:
    """History and forecast below each other, tagged, columns matched by name."""
    for prefix in ("predicted_", "forecast_"):
        if prefix + target in forecast.columns:
            forecast = forecast.withColumnRenamed(prefix + target, target)
            break
    return history.withColumn("data_type", F.lit("Historical")).unionByName(
        forecast.withColumn("data_type", F.lit("Forecast")), allowMissingColumns=True)
