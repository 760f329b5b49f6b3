"""Yearly enrolment figures and breakdowns.

All figures start from :func:`enrolment_rows`, which joins only the dimensions
that the asked columns and filters need. Year and provider are inner joins and
sit closest to the fact; the other dimensions are left joins unless asked.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.text import UNKNOWN, known
from cohortia.functions.years import start_year
from cohortia.operators.filters import CATEGORY_SOURCES, COLUMN_HOMES, FilterSet, category_column
from cohortia.sources.star import AGE, DIMENSION_KEYS, LEVEL, PROVIDER, SSA, YEAR, Star

NO_FILTERS = FilterSet()


def learners() -> Column:
    return F.count_distinct("learner_skey")


def enrolment_rows(
    star: Star,
    columns: Iterable[str],
    filters: FilterSet = NO_FILTERS,
    inner: Iterable[str] = (),
    exclude: Iterable[str] = (),
    with_provider: bool = True,
) -> DataFrame:
    """Filtered enrolments with fact columns and dimension attributes side by side.

    Without ``with_provider`` rows of unknown providers stay in.
    """
    columns = list(columns)
    filters = filters.without(exclude)
    conditions = filters.on_categories()
    attributes = [name for name in columns if name in COLUMN_HOMES]
    for name in conditions:
        attributes += CATEGORY_SOURCES[name]
    first_dims = [YEAR, PROVIDER] if with_provider else [YEAR]
    needed: dict[str, list[str]] = {name: [] for name in (*first_dims, *inner)}
    if filters.years != (None, None):
        attributes.append("academic_year")
    if filters.location is not None and with_provider:
        attributes.append("contact_town")
    for name in dict.fromkeys(attributes):
        needed.setdefault(COLUMN_HOMES[name], []).append(name)

    def frame(name: str, where: Iterable[Column] = ()) -> DataFrame:
        rows = star.dim(name, *needed[name]) if needed[name] else star.keys_of(name)
        for condition in where:
            rows = rows.where(condition)
        return rows

    limits = {YEAR: filters.on_year(), PROVIDER: filters.on_provider()}
    first = [(DIMENSION_KEYS[name], frame(name, limits.get(name, ()))) for name in (*first_dims, *inner)]
    optional = [name for name in needed if name not in {*first_dims, *inner}]
    facts = [name for name in columns if name not in COLUMN_HOMES]
    rows = star.enrolments(
        facts, inner=first, left=[(DIMENSION_KEYS[name], needed[name]) for name in optional],
        years=filters.years)
    for condition in conditions.values():
        rows = rows.where(condition)
    return rows.select(*columns)


# -- breakdowns --------------------------------------------------------------

def enrolment_trends(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    rows = enrolment_rows(star, ["academic_year", "learner_skey", "enrolment_count"], filters)
    return rows.groupBy("academic_year").agg(
        learners().alias("total_learners"), F.sum("enrolment_count").alias("total_enrolments"))


def enrolment_by_provider(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Names and towns are added after the aggregation, to the few rows left."""
    rows = enrolment_rows(
        star, ["academic_year", "provider_skey", "learner_skey", "enrolment_count"], filters)
    totals = rows.groupBy("academic_year", "provider_skey").agg(
        learners().alias("learner_count"), F.sum("enrolment_count").alias("enrolment_count"))
    return totals.join(_provider_names(star), "provider_skey").select(
        "academic_year", "provider_skey", "provider_name", "location", "college_type",
        "learner_count", "enrolment_count")


def _provider_names(star: Star) -> DataFrame:
    return star.dim(PROVIDER).select(
        "provider_skey", "provider_name", known(F.col("contact_town")).alias("location"),
        "college_type")


def enrolment_by_ssa(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Rows without a subject-area member drop out; names are not trimmed."""
    rows = enrolment_rows(
        star, ["academic_year", "ssa_tier_1_description", "learner_skey", "enrolment_count"],
        filters, inner=[SSA])
    return rows.groupBy("academic_year", F.col("ssa_tier_1_description").alias("ssa_tier1")).agg(
        learners().alias("learner_count"), F.sum("enrolment_count").alias("enrolment_count"))


def enrolment_by_age(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    rows = enrolment_rows(
        star, ["academic_year", "age_group_fes", "learner_skey"], filters, inner=[AGE])
    return rows.groupBy("academic_year", F.col("age_group_fes").alias("age_group")).agg(
        learners().alias("learner_count"))


def enrolment_by_level(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    rows = enrolment_rows(
        star, ["academic_year", "level_description", "learner_skey"], filters, inner=[LEVEL])
    return rows.groupBy("academic_year", F.col("level_description").alias("level_desc")).agg(
        learners().alias("learner_count"))


def funding_trends(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Learners and enrolments per year and funding scheme."""
    rows = enrolment_rows(
        star, ["academic_year", "funding_model", "learner_skey", "enrolment_count"], filters)
    return rows.groupBy("academic_year", category_column("funding_scheme").alias("funding_scheme")).agg(
        learners().alias("learner_count"), F.sum("enrolment_count").alias("enrolment_count"))


def time_series(star: Star, group_by: str = "total", filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Learners per year, in total, by provider or by subject area, with the start year."""
    year = start_year(F.col("academic_year")).alias("year")
    if group_by == "provider":
        rows = enrolment_rows(star, ["academic_year", "provider_skey", "learner_skey"], filters)
        counts = rows.groupBy("academic_year", "provider_skey").agg(learners().alias("learner_count"))
        names = star.dim(PROVIDER, "provider_name")
        return counts.join(names, "provider_skey").select(
            "academic_year", "provider_skey", "provider_name", "learner_count", year)
    if group_by == "ssa":
        return enrolment_by_ssa(star, filters).select(
            "academic_year", "ssa_tier1", "learner_count", year)
    rows = enrolment_rows(star, ["academic_year", "learner_skey"], filters)
    return rows.groupBy("academic_year").agg(learners().alias("learner_count")).select(
        "academic_year", "learner_count", year)


def provider_year_rollup(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Provider totals added up per year: a learner at two providers counts twice."""
    rows = enrolment_rows(star, ["academic_year", "provider_skey", "learner_skey"], filters)
    by_provider = rows.groupBy("academic_year", "provider_skey").agg(learners().alias("n"))
    return by_provider.groupBy("academic_year").agg(F.sum("n").alias("learner_count"))


# -- history used by the forecasts ------------------------------------------

def forecast_history(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Learners per year of one slice under all eight filters."""
    rows = enrolment_rows(star, ["academic_year", "learner_skey"], filters)
    counts = rows.groupBy("academic_year").agg(learners().alias("learner_count"))
    return counts.withColumn("year", start_year(F.col("academic_year"))).dropna(
        subset=["year", "learner_count"])


def ssa_history(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Learners per year and subject area; a missing name reads ``Unknown``."""
    rows = enrolment_rows(
        star, ["academic_year", "ssa_tier_1_description", "learner_skey"], filters)
    name = F.coalesce("ssa_tier_1_description", F.lit(UNKNOWN)).alias("ssa_tier1")
    counts = rows.groupBy("academic_year", name).agg(learners().alias("learner_count"))
    return counts.withColumn("year", start_year(F.col("academic_year"))).dropna(
        subset=["year", "learner_count"])


def provider_history(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Learners per year of every provider, the input of the forecasts for all keys."""
    rows = enrolment_rows(star, ["academic_year", "provider_skey", "learner_skey"], filters)
    counts = rows.groupBy("provider_skey", "academic_year").agg(learners().alias("learner_count"))
    return counts.withColumn("year", start_year(F.col("academic_year"))).dropna(subset=["year"])


# -- key figures and lists ---------------------------------------------------

def dashboard_summary(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Total learners, latest year with its learners, and number of providers.

    One pass reduces the fact to the last year of each learner. Counting those
    per last year gives the total and the latest year's count at once, without
    a second distinct count. Years are carried as their rank, because a maximum
    of integers stays in the hash aggregate where one of strings would sort.
    """
    ranks = star.dim(YEAR).select(
        DIMENSION_KEYS[YEAR], "academic_year",
        F.dense_rank().over(Window.orderBy("academic_year")).alias("year_rank"))
    rows = enrolment_rows(star, [DIMENSION_KEYS[YEAR], "learner_skey"], filters).join(
        ranks.select(DIMENSION_KEYS[YEAR], "year_rank"), DIMENSION_KEYS[YEAR])
    last_years = rows.groupBy("learner_skey").agg(F.max("year_rank").alias("year_rank"))
    by_year = last_years.groupBy("year_rank").agg(F.count("learner_skey").alias("n"))
    labelled = by_year.join(ranks.select("year_rank", "academic_year").distinct(), "year_rank")
    totals = labelled.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_learners"),
        F.coalesce(F.max("academic_year"), F.lit("N/A")).alias("current_year"),
        F.coalesce(F.max_by("n", "year_rank"), F.lit(0)).alias("current_learners"),
    )
    providers = enrolment_rows(star, ["provider_skey"], filters).agg(
        F.count_distinct("provider_skey").alias("provider_count"))
    return totals.withColumn("provider_count", providers.scalar())


def providers_list(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    present = enrolment_rows(star, ["provider_skey"], filters).distinct()
    return present.join(_provider_names(star), "provider_skey").select(
        "provider_skey", "provider_name", "college_type", "location")


def ssa_list(star: Star) -> DataFrame:
    return star.dim(SSA).select(
        F.col("ssa_tier_1_description").alias("ssa_tier1"),
        F.col("ssa_tier_2_description").alias("ssa_tier2")).distinct()


def training_set(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Learners per provider, subject area, level, funding, age and year."""
    rows = enrolment_rows(
        star,
        ["academic_year", "provider_skey", "ssa_tier_1_description", "ssa_tier_2_description",
         *CATEGORY_SOURCES["level"], "funding_model", "age_group_fes", "learner_skey"],
        filters)
    counts = rows.groupBy(
        "academic_year",
        "provider_skey",
        F.col("ssa_tier_1_description").alias("ssa_tier1"),
        F.col("ssa_tier_2_description").alias("ssa_tier2"),
        category_column("level").alias("qual_level"),
        category_column("funding_scheme").alias("funding_type_desc"),
        F.col("age_group_fes").alias("age_group"),
    ).agg(learners().alias("learner_count"))
    names = star.dim(PROVIDER).select(
        "provider_skey", "provider_name", F.col("college_type").alias("provider_type"))
    return counts.join(names, "provider_skey").select(
        "academic_year", "provider_name", "provider_type", "ssa_tier1", "ssa_tier2",
        "qual_level", "funding_type_desc", "age_group", "learner_count")
