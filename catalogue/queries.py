"""The registered queries: each reads the whole tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.oracle import (
    DEEP_PAGE, FILTER_LEVEL, FILTER_STATUS, FIRST_YEAR, LAST_YEAR, SEARCH, SLICE_FUNDING,
    SLICE_PROVIDER, SLICE_SSA, TOWN,
)
from cohortia.functions.numbers import nulls_for_non_finite
from cohortia.functions.text import known, short_label
from cohortia.functions.years import start_year, start_year_key, year_label
from cohortia.operators import enrolment as en
from cohortia.operators import options as op
from cohortia.operators import summaries as sm
from cohortia.operators.filters import CATEGORY_SOURCES, FilterSet, category_column
from cohortia.plans import explorer as ex
from cohortia.plans import programme as pg
from cohortia.session import scratch_path
from cohortia.sources.star import Star, run_sql
from cohortia.sources.tables import academic_year_of, table_star

Query = Callable[[SparkSession, str], DataFrame]

YEARS = FilterSet.of(start_year=FIRST_YEAR, end_year=LAST_YEAR)
IN_TOWN = FilterSet.of(start_year=LAST_YEAR, end_year=FIRST_YEAR, location=f" {TOWN} ")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles to a few digits, so that the last bit of an engine does not show."""
    doubles = [n for n, kind in df.dtypes if kind == "double" and (not names or n in names)]
    return df.withColumns({n: F.round(n, digits) for n in doubles})


def over_star(run: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, folder: run(table_star(spark, folder))


BOUND_SQL = """
    SELECT academic_year, count(DISTINCT learner_skey) AS total_learners
    FROM fact_enrolment JOIN dim_academic_year USING (academic_year_skey) JOIN dim_provider USING (provider_skey)
    WHERE contact_town = :town GROUP BY academic_year"""

ENROLMENT: dict[str, Query] = {
    "enrolment_trends": over_star(en.enrolment_trends),
    "trend_filtered": over_star(lambda s: en.enrolment_trends(s, IN_TOWN)),
    "enrolment_by_provider": over_star(en.enrolment_by_provider),
    "enrolment_by_ssa": over_star(en.enrolment_by_ssa),
    "enrolment_by_age": over_star(en.enrolment_by_age),
    "enrolment_by_level": over_star(en.enrolment_by_level),
    "funding_trends": over_star(en.funding_trends),
    "timeseries_total": over_star(en.time_series),
    "timeseries_provider": over_star(lambda s: en.time_series(s, "provider")),
    "timeseries_ssa": over_star(lambda s: en.time_series(s, "ssa")),
    "forecast_history_filtered": over_star(lambda s: en.forecast_history(s, FilterSet.of(
        start_year=FIRST_YEAR, end_year=LAST_YEAR, funding_scheme=SLICE_FUNDING, ssa=SLICE_SSA,
        level="Level 2"))),
    "ssa_history": over_star(lambda s: en.ssa_history(s, FilterSet.of(funding_scheme="Unknown"))),
    "dashboard_summary": over_star(en.dashboard_summary),
    "dashboard_summary_empty": over_star(
        lambda s: en.dashboard_summary(s, FilterSet.of(location="nowhere"))),
    "providers_list": over_star(lambda s: en.providers_list(s, YEARS)),
    "provider_year_rollup": over_star(en.provider_year_rollup),
    "ml_training_set": over_star(en.training_set),
    "ssa_preview": over_star(lambda s: sm.preview(en.enrolment_by_ssa(s), sm.SSA_PREVIEW)),
    "provider_preview": over_star(lambda s: sm.preview(en.enrolment_by_provider(s), sm.PROVIDER_PREVIEW)),
    "bound_sql": over_star(lambda s: run_sql(s, BOUND_SQL, town=TOWN)),
}

OPTIONS: dict[str, Query] = {
    "available_years": over_star(lambda s: op.available_years(s, FilterSet.of(location=TOWN))),
    "available_locations": over_star(lambda s: op.available_locations(s, YEARS)),
    "ssa_list": over_star(en.ssa_list),
    "funding_schemes": over_star(lambda s: op.funding_schemes(s, FilterSet.of(
        provider_id=str(SLICE_PROVIDER), start_year=FIRST_YEAR, end_year=LAST_YEAR))),
    "college_filter_options": over_star(lambda s: op.college_filter_options(s, FilterSet.of(
        provider_id=SLICE_PROVIDER, start_year=FIRST_YEAR, end_year=LAST_YEAR,
        funding_scheme=SLICE_FUNDING, ssa=SLICE_SSA, level="Level 2"))),
    "college_filter_options_open": over_star(lambda s: op.college_filter_options(s, FilterSet.of(
        ssa=SLICE_SSA, course="red widget (REF-A)"))),
    "provider_suggest": over_star(lambda s: op.suggest_providers(s, "7")),
}


# -- programme plans ---------------------------------------------------------

def over_plans(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: run(pg.programme_plans(table_star(spark, folder)))


def over_text(run: Callable[[DataFrame], DataFrame]) -> Query:
    return over_plans(lambda plans: run(ex.as_text(ex.compat_rows(plans))))


def over_snapshot(run: Callable[[ex.Snapshot], DataFrame]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = ex.compat_rows(pg.programme_plans(table_star(spark, folder)))
        return run(ex.Snapshot.write(rows, scratch_path(spark, "plans")))
    return query


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "plans-csv")
    ex.write_text_csv(ex.as_text(ex.compat_rows(pg.programme_plans(table_star(spark, folder)))), path)
    return ex.read_text_csv(spark, path)


SEARCHED = {"search": SEARCH, "filters": {
    "Approval Status": FILTER_STATUS, " Level ": FILTER_LEVEL, "No such column": "x"}}

PLANS: dict[str, Query] = {
    "year_window": over_star(pg.year_window),
    "provider_accounts": over_star(pg.provider_accounts),
    "programme_plans": over_star(pg.programme_plans),
    "plans_compat": over_plans(lambda p: ex.compat_data(ex.compat_rows(p))),
    "plans_hours_summary": over_plans(pg.hours_summary),
    "plans_hours_filtered": over_plans(lambda p: pg.hours_summary(p, "Y", " Completed ")),
    "plans_snapshot_roundtrip": over_snapshot(lambda s: s.rows),
    "plans_csv_roundtrip": csv_roundtrip,
    "plans_dataset_info": over_snapshot(lambda s: s.info().drop("last_modified")),
    "plans_filter_values": over_text(ex.filter_values),
    "plans_filter_counts": over_text(ex.filter_counts),
    "plans_quick_filters": over_text(lambda rows: ex.quick_filters(ex.filter_counts(rows))),
    "plans_page": over_snapshot(lambda s: ex.page_rows(s, 2, 100)),
    "plans_page_deep": over_snapshot(lambda s: ex.page_rows(s, DEEP_PAGE, 250)),
    "plans_page_filtered": over_snapshot(lambda s: ex.page_rows(s, 2, 20, **SEARCHED)),
    "plans_search": over_text(lambda rows: ex.search_rows(rows, f" {SEARCH.upper()}")),
    "plans_page_meta": over_text(
        lambda rows: ex.page_info(ex.search_rows(rows, **SEARCHED), 999999, 50)),
}

# -- labels and categories ---------------------------------------------------

def labelled_lines(star: Star) -> DataFrame:
    """Labels in every spelling that occurs, one per line of the orders."""
    year, number = academic_year_of(F.col("l_shipdate")), F.col("l_linenumber")
    short = year_label(year)
    label = (
        F.when(number == 1, short)
        .when(number == 2, F.concat(year, F.lit("/"), F.right((year + 1).cast("string"), F.lit(2))))
        .when(number == 3, F.concat(F.lit(" "), short, F.lit(" ")))
        .when(number == 4, F.concat(number + 3, F.lit("/8")))
        .when(number == 5, "n/a").when(number == 6, " "))
    return star.table("lineitem").select(number, "l_returnflag", label.alias("label"))


def parsed_labels(star: Star) -> DataFrame:
    label = F.col("label")
    return labelled_lines(star).select(
        "*", start_year(label).alias("start_year"), start_year_key(label).alias("start_year_key"),
    ).groupBy("l_linenumber", "l_returnflag", "label", "start_year", "start_year_key").agg(F.count("*").alias("n"))


def formatted_years(star: Star) -> DataFrame:
    years = star.table("lineitem").select(academic_year_of(F.col("l_shipdate")).alias("year"))
    return years.groupBy("year").agg(F.count("*").alias("n")).withColumn(
        "academic_year", year_label(F.col("year")))


def categories(star: Star) -> DataFrame:
    names = ["funding_scheme", "ssa", "level"]
    sources = [c for name in names for c in CATEGORY_SOURCES[name]]
    rows = en.enrolment_rows(star, ["contact_town", *sources])
    return rows.groupBy(
        known(F.col("contact_town")).alias("location"),
        *[category_column(name).alias(name) for name in names]).agg(F.count("*").alias("n"))


def courses(star: Star) -> DataFrame:
    rows = en.enrolment_rows(star, list(CATEGORY_SOURCES["course"]))
    return rows.groupBy(category_column("course").alias("course")).agg(F.count("*").alias("n"))


def short_labels(star: Star) -> DataFrame:
    rows = en.enrolment_rows(star, ["ssa_tier_1_description", "funding_model"])
    name = F.concat(F.coalesce("ssa_tier_1_description", F.lit("Unknown")), F.lit(" "),
                    category_column("funding_scheme"))
    return rows.groupBy(name.alias("ssa_tier1")).agg(F.count("*").alias("n")).withColumn(
        "short_label", short_label(F.col("ssa_tier1")))


def sanitized(star: Star) -> DataFrame:
    """Ratios with a zero divisor and roots of negatives, cleaned before they are summed."""
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    rough = star.table("lineitem").select(
        "l_linenumber", "l_returnflag",
        F.coalesce(F.try_divide(quantity, discount), F.lit(float("inf"))).alias("ratio"),
        F.sqrt(quantity - 10).alias("root"))
    return nulls_for_non_finite(rough).groupBy("l_linenumber", "l_returnflag").agg(
        F.count("*").alias("n"), F.count("ratio").alias("n_ratio"), F.count("root").alias("n_root"),
        F.sum(F.col("ratio").cast("decimal(18,4)")).cast("decimal(28,4)").alias("sum_ratio"))


def with_time_features(star: Star) -> DataFrame:
    rows = en.enrolment_rows(star, ["academic_year", "start_date"])
    months = rows.groupBy("academic_year", F.month("start_date").alias("month")).agg(F.count("*").alias("n"))
    return rounded(sm.time_features(months), "month_sin", "month_cos")


FUNCTIONS: dict[str, Query] = {
    "academic_year_parse": over_star(parsed_labels),
    "academic_year_format": over_star(formatted_years),
    "normalise_categories": over_star(categories),
    "course_label": over_star(courses),
    "ssa_short_labels": over_star(short_labels),
    "sanitize_floats": over_star(sanitized),
    "time_features": over_star(with_time_features),
}

# -- summaries, windows and reshapes -----------------------------------------

def latest_age_level(star: Star) -> DataFrame:
    age = sm.latest_year_rows(en.enrolment_by_age(star)).select(
        F.lit("age").alias("kind"), F.col("age_group").alias("name"), "learner_count")
    level = sm.latest_year_rows(en.enrolment_by_level(star)).select(
        F.lit("level").alias("kind"), F.col("level_desc").alias("name"), "learner_count")
    return age.unionByName(level)


def provider_years(star: Star) -> DataFrame:
    return en.enrolment_by_provider(star).select(
        "provider_skey", start_year(F.col("academic_year")).alias("year"), "learner_count", "enrolment_count")


def counts_by_provider(star: Star) -> DataFrame:
    return provider_years(star).drop("enrolment_count")


def order_months(star: Star) -> DataFrame:
    bounds = star.table("orders").agg(
        F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))
    return sm.date_dimension(bounds)


def prepared_series(star: Star) -> DataFrame:
    rows = en.enrolment_by_provider(star).select(
        F.col("college_type").alias("provider_type"), "academic_year", "learner_count")
    return sm.prepare_series(sm.time_features(rows), "learner_count", groups=["provider_type"])


SUMMARIES: dict[str, Query] = {
    "enrolment_summary_yoy": over_star(lambda s: sm.enrolment_summary(en.enrolment_by_ssa(s))),
    "trend_direction": over_star(lambda s: sm.trend_direction(en.enrolment_trends(s))),
    "ssa_share": over_star(lambda s: sm.ssa_breakdown(en.enrolment_by_ssa(s))),
    "kpi_metrics": over_star(lambda s: sm.kpi_metrics(en.enrolment_by_ssa(s))),
    "latest_ssa_distribution": over_star(lambda s: sm.latest_year_rows(en.enrolment_by_ssa(s))),
    "latest_age_level": over_star(latest_age_level),
    "series_prepare": over_star(prepared_series),
    "lag_features": over_star(lambda s: rounded(
        sm.lag_features(counts_by_provider(s), "learner_count", ["provider_skey"]),
        "learner_count_rolling_mean_3", "learner_count_rolling_std_3")),
    "moving_average": over_star(lambda s: rounded(
        sm.moving_average(counts_by_provider(s), "learner_count", ["provider_skey"]), "moving_average")),
    "date_dimension": over_star(order_months),
    "sequence_windows": over_star(lambda s: rounded(sm.sequence_windows(
        provider_years(s), ["learner_count", "enrolment_count"], "learner_count", ["provider_skey"]))),
}

FAMILIES = ("ENROLMENT", "OPTIONS", "PLANS", "FUNCTIONS", "SUMMARIES")
