"""Registered forecast, storage, preparation and regression queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.forecast_oracle import (
    CODE_COLUMNS, HOLD_OUT, MIDDLE_FIRST, MIDDLE_LAST, PIVOT_YEARS, PROFILED, SHORT_FIRST, SHORT_LAST,
)
from catalogue.oracle import SLICE_FUNDING, SLICE_PROVIDER, TOWN
from catalogue.queries import YEARS, Query, over_star, provider_years, rounded
from cohortia.forecasting import arima as ar
from cohortia.forecasting import orders as od
from cohortia.forecasting import evaluation as ev
from cohortia.forecasting import service as fc
from cohortia.forecasting import smoothing as smo
from cohortia.forecasting.series import clamped, forecast_rows, to_series
from cohortia.functions.years import start_year
from cohortia.operators import enrolment as en
from cohortia.operators import features as fe
from cohortia.operators import summaries as sm
from cohortia.operators.filters import FilterSet
from cohortia.operators.regression import BOOSTING, FOREST, LASSO, LINEAR, RIDGE, Regressions
from cohortia.plans import jobs
from cohortia.session import scratch_path, stored
from cohortia.sources import files
from cohortia.sources.star import Star, store_star
from cohortia.sources.tables import table_star

KEY = ["provider_skey"]
SLICE = FilterSet.of(provider_id=SLICE_PROVIDER, funding_scheme=SLICE_FUNDING)
ONE_PROVIDER = FilterSet.of(provider_id=SLICE_PROVIDER)
SHORT_TOWN = FilterSet.of(start_year=SHORT_FIRST, end_year=SHORT_LAST, location=TOWN)


def provider_series(star: Star) -> DataFrame:
    return to_series(en.provider_history(star), KEY)


def over_series(run: Callable[[DataFrame], DataFrame]) -> Query:
    return over_star(lambda star: rounded(run(provider_series(star))))


def unrounded(run: Callable[[DataFrame], DataFrame]) -> Query:
    """For short recursions: the same steps in the same order give the same bits everywhere."""
    return over_star(lambda star: run(provider_series(star)))


def per_provider(model: Callable, label: str, clamp: bool = True) -> Query:
    def run(series: DataFrame) -> DataFrame:
        done = model(series)
        if clamp:
            done = done.withColumn("steps", clamped(F.col("steps")))
        return forecast_rows(done, KEY, label).withColumnRenamed("provider_skey", "provider_key")
    return over_series(run)


def ssa_training(star: Star) -> DataFrame:
    rows = en.enrolment_by_ssa(star).where(F.col("ssa_tier1").isNotNull())
    series = to_series(rows.withColumn("year", start_year(F.col("academic_year"))), ["ssa_tier1"])
    return rounded(jobs.train_ssa(series))


def metrics(series: DataFrame) -> DataFrame:
    parts = [ev.training_metrics(series, KEY, model).drop("last_trained") for model in files.MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def selected_orders(series: DataFrame) -> DataFrame:
    return od.best_orders(od.order_candidates(series, KEY), KEY)


def combined_export(star: Star) -> DataFrame:
    yearly = sm.prepare_series(
        en.provider_history(star).select("year", "learner_count"), "learner_count")
    forecast = smo.value_forecast(to_series(yearly, []), [], "holt")
    history = yearly.withColumn("learner_count", F.col("learner_count").cast("double"))
    return sm.combine_for_export(history, forecast, "learner_count")


def ssa_map(star: Star) -> DataFrame:
    """The maps, read back entry by entry."""
    entries = F.explode("predictions").alias("academic_year", "predicted")
    return rounded(sm.year_map(fc.ssa_forecast(star)).select("ssa_tier1", entries))


def ssa_saved(star) -> DataFrame:
    """The subject-area forecast saved as a file and read back."""
    path = scratch_path(star.spark, "saved-ssa")
    files.export_tables({"arima_ssa_forecast": fc.ssa_forecast(star, "arima")}, path)
    return rounded(fc.saved_or_filtered_ssa_forecast(star, path, "arima"))


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Every way a forecast can be found: filtered, stored, saved, computed."""
    star = table_star(spark, folder)
    rows = fc.all_provider_forecasts(star, "lstm")
    store, saved = scratch_path(spark, "store"), scratch_path(spark, "saved")
    files.append_forecasts(rows, store)
    files.export_csv(rows, saved, "lstm_forecast", stamped=False)
    found = {
        "filtered": fc.resolve_forecast(star, "lstm", SLICE, store, saved),
        "stored": fc.resolve_forecast(star, "lstm", ONE_PROVIDER, store, saved),
        "saved": fc.resolve_forecast(star, "lstm", ONE_PROVIDER, f"{store}-none", saved),
        "computed": fc.resolve_forecast(star, "lstm", ONE_PROVIDER, f"{store}-none", f"{saved}-none"),
    }
    parts = [df.withColumn("source", F.lit(source)) for source, df in found.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return rounded(result)


FORECASTS: dict[str, Query] = {
    "forecast_naive": per_provider(smo.naive, "NAIVE"),
    "forecast_lstm_proxy": per_provider(smo.lstm_proxy, "LSTM"),
    "forecast_lstm_saved": per_provider(smo.lstm_saved, "LSTM", clamp=False),
    "forecast_arima": per_provider(ar.arima, "ARIMA"),
    "forecast_sarima": per_provider(ar.sarima, "SARIMA"),
    "provider_forecast": over_star(lambda s: rounded(fc.provider_forecast(s, None, ONE_PROVIDER))),
    "provider_forecast_short": over_star(lambda s: rounded(fc.provider_forecast(s, "arima", SHORT_TOWN))),
    "provider_forecast_middle": over_star(lambda s: rounded(fc.provider_forecast(
        s, "sarima", FilterSet.of(start_year=MIDDLE_FIRST, end_year=MIDDLE_LAST)))),
    "ssa_forecast": over_star(lambda s: rounded(fc.ssa_forecast(s))),
    "ssa_forecast_filtered": over_star(lambda s: rounded(
        fc.saved_or_filtered_ssa_forecast(s, "unused", "arima", SHORT_TOWN))),
    "ssa_forecast_saved": over_star(ssa_saved),
    "train_ssa_forecast": over_star(ssa_training),
    "forecast_linear": over_star(lambda s: rounded(smo.linear_trend(en.provider_history(s), KEY))),
    "exp_smoothing": unrounded(lambda series: smo.smoothed_rows(series, KEY)),
    "forecast_holt": unrounded(lambda series: smo.value_forecast(series, KEY, "holt")),
    "holt_components": unrounded(lambda series: smo.holt_rows(series, KEY)),
    "forecast_ema": unrounded(lambda series: smo.value_forecast(series, KEY, "ema")),
    "forecast_sma": over_series(lambda series: smo.value_forecast(series, KEY, "sma")),
    "order_selection": over_series(selected_orders),
    "order_candidates": over_series(lambda series: od.order_candidates(series, KEY)),
    "forecast_metrics": over_series(metrics),
    "forecast_backtest": over_series(lambda series: ev.backtest(series, KEY, fc.MODELS, HOLD_OUT)),
    "history_with_forecast": over_star(lambda s: rounded(fc.in_display_order(
        fc.history_with_forecast(s, None, SLICE)))),
    "forecast_combined_export": over_star(combined_export),
    "compare_models": over_star(lambda s: rounded(fc.compare_models(s, SLICE))),
    "ssa_forecast_pivot": over_star(lambda s: sm.pivot_years(fc.ssa_forecast(s), list(PIVOT_YEARS))),
    "ssa_forecast_map": over_star(ssa_map),
    "forecast_resolve": resolved,
}


# -- storage ----------------------------------------------------------------------

def store_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs stored; all rows, and the newest per provider and year."""
    star, path = table_star(spark, folder), scratch_path(spark, "store")
    rows = fc.all_provider_forecasts(star, "sarima").drop("year")
    for _ in range(2):
        files.append_forecasts(rows, path)
    kept = [files.stored_forecasts(spark, path, "sarima", latest_only=latest).withColumn("run", F.lit(run))
            for run, latest in (("all", False), ("latest", True))]
    return rounded(kept[0].unionByName(kept[1]).drop("created_at"))


def saved_read(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "saved")
    rows = fc.all_provider_forecasts(table_star(spark, folder), "lstm")
    return rounded(files.saved_forecast(
        spark, files.export_csv(rows, path, "lstm_forecast", stamped=False), SLICE_PROVIDER))


def trained(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    data, output = scratch_path(spark, "extracts"), scratch_path(spark, "models")
    jobs.refresh_extracts(table_star(spark, folder), data)
    return jobs.train_all(spark, data, output), output


def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    _, output = trained(spark, folder)
    return files.model_accuracy(spark, f"{output}/metrics").drop("last_trained")


OFFLINE_MEASURES = {
    "enrolment_summary": "learner_count", "ssa_breakdown": "learner_count", "enrolment_trends": "total_learners",
    "age_breakdown": "learner_count", "funding_trends": "learner_count", "forecast_combined": "learner_count",
    "kpi_metrics": "total_learners",
}


def offline_exports(spark: SparkSession, folder: str) -> DataFrame:
    """The whole offline run: rows and learners (forecasts apart) of every exported table, rows of the model results."""
    output = scratch_path(spark, "offline")
    done = jobs.run_offline(table_star(spark, folder), output)
    results = done.get("model_results")
    parts = [] if results is None else [results.agg(F.count("*").alias("row_count")).select(
        F.lit("model_results").alias("name"), "row_count", F.lit(None).cast("bigint").alias("learners"))]
    for name, measure in OFFLINE_MEASURES.items():
        rows = spark.read.option("header", True).csv(f"{output}/{name}")
        counted = F.col("data_type") == "Historical" if "data_type" in rows.columns else F.lit(True)
        parts.append(rows.agg(F.count("*").alias("row_count"), F.sum(
            F.when(counted, F.col(measure).cast("double"))).cast("bigint").alias("learners")).select(
            F.lit(name).alias("name"), "row_count", "learners"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def stored_star_trends(spark: SparkSession, folder: str) -> DataFrame:
    """Trend of a range of years over a star stored by academic year."""
    star = store_star(table_star(spark, folder), scratch_path(spark, "stored-star"))
    return en.enrolment_trends(star, YEARS)


def star_export(spark: SparkSession, folder: str) -> DataFrame:
    star = table_star(spark, folder)
    tables = jobs.star_model(star, fc.all_provider_forecasts(star, "lstm"))
    return files.row_counts(spark, files.export_tables(tables, scratch_path(spark, "star")))


STORAGE: dict[str, Query] = {
    "refresh_extracts": lambda spark, folder: jobs.refresh_extracts(
        table_star(spark, folder), scratch_path(spark, "extracts")),
    "forecast_store_roundtrip": store_roundtrip,
    "forecast_saved_read": saved_read,
    "model_accuracy": accuracy,
    "train_all_counts": lambda spark, folder: trained(spark, folder)[0],
    "export_star_model": star_export,
    "offline_exports": offline_exports,
    "stored_star_trends": stored_star_trends,
    "table_profile": over_star(lambda s: files.table_profile({name: s.table(name) for name in PROFILED})),
}


# -- preparation and regression -----------------------------------------------------

def cleaned(star: Star) -> DataFrame:
    return fe.clean_data(en.enrolment_rows(star, [
        "academic_year", "ssa_tier_1_description", "enrolment_count", "guided_learning_hours", "learner_skey"]))


def encoded(star: Star) -> DataFrame:
    columns = list(CODE_COLUMNS)
    rows = fe.encode_categories(stored(en.training_set(star), "to-encode"), columns)
    return rows.groupBy(*columns, *[f"{c}_encoded" for c in columns]).agg(F.count("*").alias("n"))


SPLIT_KEYS = ["academic_year", *jobs.CATEGORY_COLUMNS]


def split(star: Star) -> DataFrame:
    train, test = fe.train_test_split(en.training_set(star), SPLIT_KEYS)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part", "academic_year").agg(
        F.count("*").alias("n"), F.sum("learner_count").alias("learners"))


def regression_parts(star: Star) -> tuple[DataFrame, DataFrame, list[str]]:
    rows, names = jobs.encoded_training_set(star)
    train, test = fe.train_test_split(rows, SPLIT_KEYS)
    return train, test, names


def regression_compare(star: Star) -> DataFrame:
    train, test, names = regression_parts(star)
    return Regressions(names).fit(train).compare(test)


def feature_importance(star: Star) -> DataFrame:
    train, _, names = regression_parts(star)
    return Regressions(names).fit(train, [FOREST, BOOSTING]).importance(star.spark)


def regression_predict(star: Star) -> DataFrame:
    train, test, names = regression_parts(star)
    predicted = Regressions(names).fit(train, [LINEAR, RIDGE]).predict(test, LINEAR)
    return rounded(predicted.groupBy("academic_year").agg(
        F.count("*").alias("n"), F.avg("learner_count").alias("learners"),
        F.avg("prediction").alias("predicted")))


def linear_compare(star: Star) -> DataFrame:
    train, test, names = regression_parts(star)
    return rounded(Regressions(names).fit(train, [LINEAR, RIDGE, LASSO]).compare(test))


def linear_coefficients(star: Star) -> DataFrame:
    train, _, names = regression_parts(star)
    return rounded(Regressions(names).fit(train, [LINEAR, RIDGE, LASSO]).coefficients(star.spark))


PREPARATION: dict[str, Query] = {
    "clean_data": over_star(cleaned),
    "label_encode": over_star(encoded),
    "scale_standard": over_star(lambda s: rounded(sm.scale_standard(
        provider_years(s), ["learner_count", "enrolment_count"]))),
    "scale_minmax": over_star(lambda s: rounded(sm.scale_minmax(
        provider_years(s), ["learner_count", "enrolment_count"]))),
    "train_test_split": over_star(split),
    "feature_summary": over_star(lambda s: fe.feature_summary(en.training_set(s))),
    "regression_compare": over_star(regression_compare),
    "feature_importance": over_star(feature_importance),
    "regression_predict": over_star(regression_predict),
    "regression_linear_compare": over_star(linear_compare),
    "regression_coefficients": over_star(linear_coefficients),
}

FAMILIES = ("FORECASTS", "STORAGE", "PREPARATION")
