"""Batch jobs: refresh the extracts, train the models, run the offline steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.forecasting.arima import arima, sarima, ssa_training
from cohortia.forecasting.evaluation import training_metrics
from cohortia.forecasting.series import FORECAST_PERIODS, forecast_rows, to_series
from cohortia.forecasting.smoothing import lstm_saved, value_forecast
from cohortia.functions.years import start_year
from cohortia.operators import enrolment as en
from cohortia.operators import features, summaries
from cohortia.operators.regression import Regressions
from cohortia.plans.explorer import Snapshot, compat_rows
from cohortia.plans.programme import programme_plans
from cohortia.sources.files import export_csv, export_tables, open_if_present, row_counts, write_metrics
from cohortia.session import shuffle_width, stored
from cohortia.sources.star import AGE, DIMENSION_KEYS, LEVEL, PROVIDER, SSA, YEAR, Star

TRAINED = {"arima": arima, "sarima": sarima, "lstm": lstm_saved}
CATEGORY_COLUMNS = [
    "provider_name", "provider_type", "ssa_tier1", "ssa_tier2", "qual_level", "funding_type_desc",
    "age_group"]
FEWEST_TRAINING_ROWS, FEWEST_YEARS = 20, 3


# -- refresh ---------------------------------------------------------------------

EXTRACT_NAMES = {
    "enrolment_by_ssa": ("ssa_tier1", "string"),
    "enrolment_by_provider": ("provider_skey", "bigint"),
    "enrolment_by_age": ("age_group", "string"),
    "enrolment_by_level": ("level_desc", "string"),
}
LEARNERS_ONLY = ("enrolment_by_age", "enrolment_by_level")
LOOSE_PARTS = 1000  # groups of lines without a learner


def extract_counts(star: Star) -> DataFrame:
    """Figures of all five extracts as (extract, academic_year, name) rows.

    The fact is read and joined once. Each enrolment then counts in every
    breakdown that knows its member; missing members drop out of theirs only.
    The lines move once, narrow and to their learner, before they are counted five times: so
    what is distinct is found where the learner is, in maps that shrink with the
    partitions. Lines without a learner are spread over all partitions.
    """
    def members(name: str, column: str) -> DataFrame:
        return star.dim(name).select(DIMENSION_KEYS[name], F.col(column), F.lit(True).alias(f"in_{name}"))

    labels = star.dim(YEAR).select(DIMENSION_KEYS[YEAR], "academic_year")
    described = ((AGE, "age_group_fes"), (SSA, "ssa_tier_1_description"), (LEVEL, "level_description"))
    rows = star.enrolments(
        ["provider_skey", "learner_skey", "enrolment_count"],
        inner=[(DIMENSION_KEYS[YEAR], labels)],
        left=[(DIMENSION_KEYS[name], members(name, column)) for name, column in described])

    def entry(extract: str, value, known=F.lit(True)):
        fields = F.struct(F.lit(extract).alias("extract"), value.cast("string").alias("name"))
        return F.when(known, fields)

    entries = F.array_compact(F.array(
        entry("enrolment_total", F.lit(None)),
        entry("enrolment_by_ssa", F.col("ssa_tier_1_description"), F.col(f"in_{SSA}")),
        entry("enrolment_by_provider", F.col("provider_skey")),
        entry("enrolment_by_age", F.col("age_group_fes"), F.col(f"in_{AGE}")),
        entry("enrolment_by_level", F.col("level_description"), F.col(f"in_{LEVEL}")),
    ))
    content = F.xxhash64("provider_skey", "academic_year", "enrolment_count", "ssa_tier_1_description", "level_description")
    spread = F.when(F.col("learner_skey").isNull(), F.pmod(content, F.lit(LOOSE_PARTS)))
    lines = rows.withColumn("spread", spread).repartition(shuffle_width(star.spark), "learner_skey", "spread")
    per_learner = lines.select("academic_year", "learner_skey", "spread", "enrolment_count", F.inline(entries)).groupBy(
        "extract", "academic_year", "name", "learner_skey", "spread").agg(F.sum("enrolment_count").alias("enrolment_count"))
    return per_learner.groupBy("extract", "academic_year", "name").agg(
        F.count("learner_skey").alias("learner_count"), F.sum("enrolment_count").alias("enrolment_count"))


def extracts(star: Star) -> dict[str, DataFrame]:
    """The five yearly extracts. Only the provider extract needs a known provider."""
    counts = stored(extract_counts(star), "extract-counts")

    def part(extract: str) -> DataFrame:
        rows = counts.where(F.col("extract") == extract)
        measures = ["learner_count"] + ([] if extract in LEARNERS_ONLY else ["enrolment_count"])
        if extract not in EXTRACT_NAMES:
            return rows.select("academic_year", *measures)
        name, kind = EXTRACT_NAMES[extract]
        return rows.select("academic_year", F.col("name").cast(kind).alias(name), *measures)

    tables = {extract: part(extract) for extract in ("enrolment_total", *EXTRACT_NAMES)}
    providers = star.dim(PROVIDER).select("provider_skey", "provider_name", "college_type")
    by_provider = tables["enrolment_by_provider"].join(providers, "provider_skey")
    return {**tables, "enrolment_by_provider": by_provider}


def refresh_extracts(star: Star, folder: str) -> DataFrame:
    """Write all extracts to a new folder; returns their row counts."""
    return row_counts(star.spark, export_tables(extracts(star), folder))


def refresh_snapshot(star: Star, folder: str) -> Snapshot:
    """Write the plan snapshot to a new folder; readers switch when it is complete."""
    return Snapshot.write(compat_rows(programme_plans(star)), folder)


# -- training --------------------------------------------------------------------

def train_all(spark, data: str, output: str, periods: int = FORECAST_PERIODS) -> DataFrame:
    """Train on the extracts; writes forecasts and metrics, returns rows per model."""
    total = open_if_present(spark, f"{data}/enrolment_total")
    if total is None:
        raise RuntimeError("Extracts not found. Refresh the data before training models.")
    year = start_year(F.col("academic_year"))
    series = to_series(total.withColumn("year", year), []).persist()  # one row
    by_ssa = spark.read.parquet(f"{data}/enrolment_by_ssa").where(F.col("ssa_tier1").isNotNull())
    ssa_series = to_series(by_ssa.withColumn("year", year), ["ssa_tier1"])
    paths = {}
    try:
        for name, run in TRAINED.items():
            paths[name] = f"{output}/{name}_forecast_rows"
            rows = forecast_rows(run(series, periods), [], name.upper())
            rows.write.mode("overwrite").parquet(paths[name])
            export_csv(rows, output, f"{name}_forecast", stamped=False)
            write_metrics(training_metrics(series, [], name, periods), f"{output}/metrics", name)
        ssa_rows = train_ssa(ssa_series, periods)
        for name in TRAINED:
            paths_ssa = f"{output}/{name}_ssa_forecast"
            ssa_rows.where(F.col("model_type") == name.upper()).write.mode("overwrite").parquet(paths_ssa)
        paths["ssa"] = f"{output}/sarima_ssa_forecast"
    finally:
        series.unpersist()
    return row_counts(spark, paths).withColumnRenamed("name", "model")


def train_ssa(series: DataFrame, periods: int = FORECAST_PERIODS) -> DataFrame:
    """The subject-area forecast; the same rows stand for all three models."""
    rows = forecast_rows(ssa_training(series, periods), ["ssa_tier1"], "").drop("model_type", "year")
    names = F.array(*[F.lit(name.upper()) for name in TRAINED])
    return rows.select("*", F.explode(names).alias("model_type"))


# -- offline steps ---------------------------------------------------------------

def encoded_training_set(star: Star) -> tuple[DataFrame, list[str]]:
    """Cleaned and encoded training rows with the names of their features."""
    rows = features.clean_data(en.training_set(star))
    encoded = features.encode_categories(summaries.time_features(rows), CATEGORY_COLUMNS)
    return stored(encoded, "encoded"), [f"{c}_encoded" for c in CATEGORY_COLUMNS] + ["year"]


def star_model(star: Star, forecast: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the exported model: fact, dates, dimensions and a forecast if given."""
    fact = star.enrolments(["learner_skey", "provider_skey", "academic_year_skey", "ssa_skey", "age_skey",
                            "enrolment_count", "start_date"])
    bounds = fact.agg(F.min("start_date").alias("first"), F.max("start_date").alias("last"))
    tables = {
        "fact_enrolment": fact,
        "dim_date": summaries.date_dimension(bounds),
        "dim_ssa": star.dim(SSA),
        "dim_age": star.dim(AGE),
        "dim_provider": star.dim(PROVIDER),
    }
    if forecast is not None:
        tables["fact_forecast"] = forecast
    return tables


def run_offline(star: Star, folder: str, train: bool = True) -> dict[str, DataFrame]:
    """Extract, clean, encode, train, forecast and export; returns the frames."""
    trends, age, funding = en.enrolment_trends(star), en.enrolment_by_age(star), en.funding_trends(star)
    rows = features.clean_data(en.training_set(star))
    rows = stored(summaries.time_features(rows), "cleaned")
    results = None
    if train:
        encoded = features.encode_categories(rows, CATEGORY_COLUMNS)
        names = [f"{c}_encoded" for c in CATEGORY_COLUMNS] + ["year"]
        usable = stored(encoded.dropna(subset=[*names, "learner_count"]), "encoded")
        if usable.limit(FEWEST_TRAINING_ROWS + 1).count() > FEWEST_TRAINING_ROWS:
            fit_rows, test_rows = features.train_test_split(usable, [*CATEGORY_COLUMNS, "academic_year"])
            results = Regressions(names).fit(fit_rows).compare(test_rows)

    yearly = summaries.prepare_series(rows, "learner_count")
    series = to_series(yearly, [])
    forecast = value_forecast(series.where(F.size("y") >= FEWEST_YEARS), [], "holt")
    exports = {
        "enrolment_summary": summaries.enrolment_summary(rows),
        "ssa_breakdown": summaries.ssa_breakdown(rows),
        "enrolment_trends": trends,
        "age_breakdown": age,
        "funding_trends": funding,
        "forecast_combined": summaries.combine_for_export(yearly, forecast, "learner_count"),
        "kpi_metrics": summaries.kpi_metrics(rows),
    }
    for name, df in exports.items():
        export_csv(df, folder, name, stamped=False)
    return {**exports, **({"model_results": results} if results is not None else {})}
