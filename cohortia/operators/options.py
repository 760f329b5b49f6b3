"""Option lists for the filter controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.functions.text import known
from cohortia.functions.years import start_year
from cohortia.operators.enrolment import NO_FILTERS, enrolment_rows
from cohortia.operators.filters import CATEGORY_SOURCES, FilterSet, category_column
from cohortia.sources.star import PROVIDER, Star

SUGGESTION_LIMIT = 12


def available_years(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """One label per start year that has enrolments."""
    labels = enrolment_rows(star, ["academic_year"], filters).distinct()
    label = F.trim("academic_year")
    return (
        labels.select(start_year(F.col("academic_year")).alias("value"), label.alias("label"))
        .where(F.col("value").isNotNull() & (F.col("label") != ""))
        .groupBy("value").agg(F.min("label").alias("label"))
    )


def available_locations(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Towns with enrolments: reduced to provider keys first, named afterwards."""
    present = enrolment_rows(star, ["provider_skey"], filters).distinct()
    towns = star.dim(PROVIDER).select("provider_skey", known(F.col("contact_town")).alias("location"))
    return present.join(towns, "provider_skey").select("location").distinct()


def funding_schemes(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    rows = enrolment_rows(star, ["funding_model"], filters)
    return rows.select(category_column("funding_scheme").alias("funding_scheme")).distinct()


def college_filter_options(star: Star, filters: FilterSet = NO_FILTERS) -> DataFrame:
    """Four cascading lists as (filter, value) rows, from one pass over the fact.

    Each list obeys every filter but its own. A row is reduced to its
    combination of categories, which then counts for every list whose other
    filters it passes. Courses are listed only for a chosen provider.
    """
    with_courses = filters.provider_id is not None
    listed = ["funding_scheme", "ssa", "level"] + (["course"] if with_courses else [])
    conditions = filters.on_categories()
    shared = FilterSet(
        provider_id=filters.provider_id, location=filters.location,
        start_year=filters.start_year, end_year=filters.end_year)
    columns = [c for name in dict.fromkeys([*listed, *conditions]) for c in CATEGORY_SOURCES[name]]
    rows = enrolment_rows(star, columns, shared)

    passes = {name: condition.alias(f"{name}_ok") for name, condition in conditions.items()}
    combos = rows.select(
        *[category_column(name).alias(name) for name in listed], *passes.values()).distinct()

    def entry(name: str):
        others = [F.col(f"{other}_ok") for other in passes if other != name]
        ok = F.lit(True)
        for other in others:
            ok = ok & other
        return F.struct(F.lit(name).alias("filter"), F.trim(name).alias("value"), ok.alias("ok"))

    options = (
        combos.select(F.inline(F.array(*[entry(name) for name in listed])))
        .where(F.col("ok") & (F.col("value") != ""))
        .select("filter", "value").distinct()
    )
    flag = star.spark.range(1).select(
        F.lit("course_requires_college").alias("filter"),
        F.lit("false" if with_courses else "true").alias("value"))
    return options.unionByName(flag)


def suggest_providers(star: Star, query: str | None, limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """First providers whose name holds the query, with match and total counts."""
    present = enrolment_rows(star, ["provider_skey"]).distinct()
    names = present.join(
        star.dim(PROVIDER, "provider_name").withColumn("provider_name", F.trim("provider_name")),
        "provider_skey").where(F.col("provider_name") != "")
    needle = (query or "").strip().lower()
    matches = names.where(F.contains(F.lower("provider_name"), F.lit(needle)))
    counts = names.agg(F.struct(
        F.count_if(F.contains(F.lower("provider_name"), F.lit(needle))).alias("matched_count"),
        F.count("*").alias("total_count")).alias("counts")).scalar()
    return matches.orderBy("provider_name", "provider_skey").limit(limit).select(
        "*", counts["matched_count"].alias("matched_count"), counts["total_count"].alias("total_count"))
