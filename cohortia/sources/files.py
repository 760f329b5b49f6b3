"""Stored forecasts, metrics, exports and the table catalogue."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortia.forecasting.series import FORECAST_SCHEMA

MODELS = ("arima", "sarima", "lstm")
METRICS_SCHEMA = (
    "model string, `order` string, mae double, rmse double, mape double, data_points bigint, "
    "forecast_periods bigint, last_trained string")


def open_if_present(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame | None:
    """The stored frame, or None where nothing has been written yet."""
    try:
        return spark.read.format(kind).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# -- forecast store ------------------------------------------------------------

def append_forecasts(forecast: DataFrame, path: str) -> None:
    """Add forecast rows with the time of writing; one folder per model."""
    forecast.withColumn("created_at", F.current_timestamp()).write.partitionBy("model_type").mode(
        "append").parquet(path)


def stored_forecasts(spark: SparkSession, path: str, model: str, provider_id: int | None = None,
                     latest_only: bool = False) -> DataFrame | None:
    """Rows of one model; only its folder is read.

    Rows of earlier runs stay in unless ``latest_only`` asks for the newest
    row per provider and year.
    """
    stored = open_if_present(spark, path)
    if stored is None:
        return None
    rows = stored.where(F.col("model_type") == model.upper())
    if provider_id is not None:
        rows = rows.where(F.col("provider_key") == provider_id)
    if latest_only:
        newest = Window.partitionBy("provider_key", "academic_year").orderBy(F.desc("created_at"))
        rows = rows.withColumn("age", F.row_number().over(newest)).where("age = 1").drop("age")
    return rows


def saved_forecast(spark: SparkSession, path: str, provider_id: int | None = None,
                   kind: str = "csv") -> DataFrame | None:
    """A forecast file in the common schema; text that is no number becomes NULL.

    With a provider asked, a file without provider keys has no rows for it.
    """
    saved = open_if_present(spark, path, kind, header=True)
    if saved is None:
        return None
    present = {name.lower(): name for name in saved.columns}

    def column(field) -> Column:
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return F.col(present[field.name]).try_cast(field.dataType).alias(field.name)

    rows = saved.select(*[column(field) for field in FORECAST_SCHEMA])
    if provider_id is not None:
        if "provider_key" not in present:
            return rows.where(F.lit(False))
        rows = rows.where(F.col("provider_key") == provider_id)
    return rows


# -- metrics ---------------------------------------------------------------------

def write_metrics(metrics: DataFrame, path: str, model: str) -> None:
    """Metrics of one model; a new run takes the place of the old one."""
    metrics.write.mode("overwrite").json(f"{path}/{model}")


def model_accuracy(spark: SparkSession, path: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Metrics of every model; NULLs where a model has none."""
    names = spark.createDataFrame([(m.upper(),) for m in models], "model string")
    try:
        metrics = spark.read.schema(METRICS_SCHEMA).option("recursiveFileLookup", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        metrics = spark.createDataFrame([], METRICS_SCHEMA)
    return names.join(metrics, "model", "left")


# -- exports ---------------------------------------------------------------------

def export_csv(df: DataFrame, folder: str, name: str, stamped: bool = True) -> str:
    """Write as CSV below ``folder``, with the time of the run in the name if asked."""
    stamp = datetime.now(timezone.utc).strftime("_%Y%m%d_%H%M%S") if stamped else ""
    path = f"{folder}/{name}{stamp}"
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
    return path


def export_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One Parquet folder per table."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows per written table, counted from the files."""
    counts = [
        spark.read.parquet(path).agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("name"), "row_count")
        for name, path in paths.items()]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


# -- catalogue -------------------------------------------------------------------

def table_profile(tables: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    """Place, type, rows, NULLs and distinct values of every column.

    Exact distinct counts run column by column over one exploded pass, so that
    no wide distinct plan is needed; ``exact=False`` counts approximately in a
    single aggregation.
    """
    parts = [(_exact_profile if exact else _sketched_profile)(name, df) for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _described(name: str, df: DataFrame) -> DataFrame:
    described = [(name, field.name, place, field.dataType.simpleString())
                 for place, field in enumerate(df.schema, start=1)]
    return df.sparkSession.createDataFrame(
        described, "table_name string, column_name string, ordinal_position int, data_type string")


def _exact_profile(name: str, df: DataFrame) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(field.name).alias("column_name"), F.col(f"`{field.name}`").cast("string").alias("value"))
        for field in df.schema])
    values = df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    counts = values.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"))
    return _described(name, df).join(counts, "column_name", "left").select(
        "table_name", "column_name", "ordinal_position", "data_type",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("row_count", "null_count", "distinct_count")])


def _sketched_profile(name: str, df: DataFrame) -> DataFrame:
    figures = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        figures.append(F.struct(
            F.lit(field.name).alias("column_name"), F.count("*").alias("row_count"),
            F.count_if(column.isNull()).alias("null_count"),
            F.approx_count_distinct(column).alias("distinct_count")))
    counts = df.agg(F.array(*figures).alias("figures")).select(F.inline("figures"))
    return _described(name, df).join(counts, "column_name").select(
        "table_name", "column_name", "ordinal_position", "data_type", "row_count", "null_count",
        "distinct_count")
