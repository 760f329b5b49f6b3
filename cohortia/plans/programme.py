"""Programme plans: the year window, provider accounts and the plan itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.numbers import contribution
from cohortia.functions.text import UNKNOWN, completion_label, infill_flag, site_label
from cohortia.functions.years import two_digit_key
from cohortia.sources.star import (
    AIM, COST_COLUMNS, DELIVERY, DIMENSION_KEYS, LEARNER, LEVEL, PROVIDER, SSA, YEAR, Star,
)

# Names that users of the plan know.
FUNDING_16_18 = "16-19 (excluding Apprenticeships)"
FUNDING_ADULT = "%Adult Skills%"
FUNDING_APPRENTICE = "%Apprenticeship%"
GRAND_TOTAL = "Grand Total"

GROUP_KEYS = (
    "ca_name", "prog_code", "prog_name", "aim", "level_desc", "site", "course_id", "parent",
    "approval_status", "infill",
)
# A total order: the four columns of the report first, then the other keys.
PLAN_ORDER = (
    "ca_name", "prog_name", "aim", "site", "prog_code", "level_desc", "course_id", "parent",
    "approval_status", "infill",
)

PLAN_COLUMNS = (
    "ca_name", "prog_code", "prog_name", "aim", "level_desc", "site", "course_id", "start_date",
    "end_date", "main_qual_glh", "tutorial_hours", "blended_hours", "review_hours", "as_hours",
    "groups_2021_22", "groups_2022_23", "actual_16_18_21_22", "aeb_actual_21_22",
    "fcr_actual_21_22", "total_actual_learners_21_22", "target_16_18_22_23", "aeb_target_22_23",
    "total_target_learners_22_23", "cs_risk_rating", "total_income_22_23", "total_costs",
    "contribution_pct", "infill_parent_prog_code", "parent", "approval_status", "infill",
)


def year_window(star: Star) -> DataFrame:
    """One row: the newest enrolled year (target) and the year before it (actual)."""
    return _enrolled_window(star).select("target_year_key", "actual_year_key")


def _enrolled_window(star: Star) -> DataFrame:
    """The window with the first and last enrolled year member that has one of its labels.

    A two-digit label names a year of every century, so the members come from the enrolments.
    """
    member = DIMENSION_KEYS[YEAR]
    labels = star.dim(YEAR).select(member, two_digit_key(F.col("academic_year")).alias("year_key"))
    spans = star.enrolments([member], inner=[(member, labels)]).groupBy("year_key").agg(
        F.min(member).alias("first"), F.max(member).alias("last"))
    by_key = F.filter(F.collect_list(F.struct("year_key", "first", "last")), lambda s: s["year_key"].isNotNull())
    window = spans.agg(F.max("year_key").alias("target_year_key"), by_key.alias("spans")).withColumn(
        "actual_year_key", F.col("target_year_key") - 1)

    def ends(*keys: str) -> Column:
        return F.filter("spans", lambda s: s["year_key"].isin(*[F.col(k) for k in keys]))

    both, target = ends("target_year_key", "actual_year_key"), ends("target_year_key")
    return window.select(
        "target_year_key", "actual_year_key",
        F.array_min(both["first"]).alias("first"), F.array_max(both["last"]).alias("last"),
        F.array_min(target["first"]).alias("target_first"), F.array_max(target["last"]).alias("target_last"))


def _window_years(star: Star, target: Column, target_only: bool = False) -> DataFrame:
    """Year members inside the window, flagged.

    The window enters as a scalar subquery, so it limits the year dimension
    itself and, through it, the fact before any wide join.
    """
    years = star.dim(YEAR).select(
        DIMENSION_KEYS[YEAR], two_digit_key(F.col("academic_year")).alias("year_key"))
    inside = years.where(
        F.col("year_key") == target if target_only else F.col("year_key").isin(target, target - 1))
    return inside.withColumn("is_target", F.col("year_key") == target)


def provider_accounts(star: Star, target_only: bool = False) -> DataFrame:
    """Income, costs and contribution share per provider and year of the window."""
    window = _enrolled_window(star)
    target = window.select("target_year_key").scalar()
    years = _window_years(star, target, target_only).select(DIMENSION_KEYS[YEAR], "year_key")
    zero = F.lit(0).cast("decimal(18,4)")
    costs = F.coalesce(F.col(COST_COLUMNS[0]), zero)
    for name in COST_COLUMNS[1:]:
        costs = costs + F.coalesce(F.col(name), zero)
    bounds = window.select("target_first", "target_last") if target_only else window.select("first", "last")
    sums = star.accounts(bounds).join(years, DIMENSION_KEYS[YEAR]).groupBy("provider_skey", "year_key").agg(
        F.sum(F.coalesce("adjusted_income", zero)).cast("decimal(28,4)").alias("total_income"),
        F.sum(costs).cast("decimal(28,4)").alias("total_costs"))
    return sums.withColumn(
        "contribution_pct", contribution(F.col("total_income"), F.col("total_costs")))


def programme_plans(star: Star) -> DataFrame:
    """One row per programme with activity in the window."""
    window = _enrolled_window(star)
    target = window.select("target_year_key").scalar()
    years = _window_years(star, target).select(DIMENSION_KEYS[YEAR], "is_target")
    # Account figures are shown for the target year only, one row per provider.
    accounts = provider_accounts(star, target_only=True).select(
        "provider_skey", "total_income", F.col("total_costs").alias("account_costs"), "contribution_pct")
    # Large dimensions first, while the rows are narrow; the lists of a few
    # members come last, when nothing is shuffled for them any more.
    members = {
        LEARNER: ["campus_identifier", "campus_id", "planned_eep_hours"],
        AIM: ["learn_aim_ref", "learn_aim_ref_title", "nvq_level_v2", "nvq_level",
              F.col("guided_learning_hours").alias("aim_hours")],
        PROVIDER: ["provider_name"],
        SSA: ["ssa_tier_1_description"],
        LEVEL: ["level_description"],
        DELIVERY: ["funding_model", "programme_type", "learning_aim_reference",
                   "completion_status", "completion_status_code", "is_non_funded"],
    }
    dimensions = [(DIMENSION_KEYS[name], columns) for name, columns in members.items()]
    rows = star.enrolments(
        ["enrolment_count", "guided_learning_hours", "start_date", "planned_end_date", "actual_end_date"],
        inner=[(DIMENSION_KEYS[YEAR], years)],
        left=[(DIMENSION_KEYS[PROVIDER], accounts), *dimensions],
        years=window.select("first", "last"))

    def or_unknown(*names: str) -> Column:
        return F.coalesce(*names, F.lit(UNKNOWN))

    is_target = F.col("is_target")
    funding = F.col("funding_model")
    count = F.coalesce("enrolment_count", F.lit(0))

    def counted(when: Column) -> Column:
        return F.sum(F.when(when, count).otherwise(0))

    def in_target(name: str) -> Column:
        return F.max(F.when(is_target, F.col(name)))

    keyed = rows.select(
        "*",
        or_unknown("ssa_tier_1_description").alias("ca_name"),
        or_unknown("programme_type").alias("prog_code"),
        or_unknown("learn_aim_ref_title", "programme_type").alias("prog_name"),
        or_unknown("learn_aim_ref", "learning_aim_reference").alias("aim"),
        or_unknown("level_description", "nvq_level_v2", "nvq_level").alias("level_desc"),
        site_label(F.col("campus_identifier"), F.col("campus_id")).alias("site"),
        or_unknown("learning_aim_reference", "learn_aim_ref").alias("course_id"),
        or_unknown("provider_name").alias("parent"),
        completion_label(F.col("completion_status"), F.col("completion_status_code"))
        .alias("approval_status"),
        infill_flag(F.col("is_non_funded")).alias("infill"),
    )
    zero = F.lit(0.0)
    no_text = F.lit(None).cast("string")
    plans = keyed.groupBy(*GROUP_KEYS).agg(
        F.min("start_date").alias("start_date"),
        F.max(F.coalesce("planned_end_date", "actual_end_date")).alias("end_date"),
        F.sum(F.coalesce("guided_learning_hours", "aim_hours", F.lit(0))).alias("main_qual_glh"),
        F.sum(F.coalesce("planned_eep_hours", F.lit(0))).alias("as_hours"),
        counted(~is_target).alias("groups_2021_22"),
        counted(is_target).alias("groups_2022_23"),
        counted(~is_target & (funding == FUNDING_16_18)).alias("actual_16_18_21_22"),
        counted(~is_target & funding.ilike(FUNDING_ADULT)).alias("aeb_actual_21_22"),
        counted(~is_target & funding.ilike(FUNDING_APPRENTICE)).alias("fcr_actual_21_22"),
        counted(is_target & (funding == FUNDING_16_18)).alias("target_16_18_22_23"),
        counted(is_target & funding.ilike(FUNDING_ADULT)).alias("aeb_target_22_23"),
        in_target("total_income").alias("total_income_22_23"),
        in_target("account_costs").alias("total_costs"),
        in_target("contribution_pct").alias("contribution_pct"),
    ).withColumns({
        "tutorial_hours": zero,
        "blended_hours": zero,
        "review_hours": zero,
        "total_actual_learners_21_22": F.col("groups_2021_22"),
        "total_target_learners_22_23": F.col("groups_2022_23"),
        "cs_risk_rating": no_text,
        "infill_parent_prog_code": no_text,
    })
    active = (F.col("groups_2021_22") > 0) | (F.col("groups_2022_23") > 0)
    return plans.where(active).select(*PLAN_COLUMNS)


def hours_summary(plans: DataFrame, infill: str | None = None, approval_status: str | None = None) -> DataFrame:
    """Hours per curriculum area and a total row; no rows at all for no plans.

    The rollup runs over the aggregated areas, not over the plans.
    """
    hours = ("main_qual_glh", "blended_hours", "tutorial_hours")
    kept = narrow(plans, infill, approval_status)
    areas = kept.groupBy("ca_name").agg(*[F.sum(name).cast("double").alias(name) for name in hours])
    label = F.when(F.grouping_id() == 1, GRAND_TOTAL).otherwise(F.col("ca_name"))
    return areas.rollup("ca_name").agg(
        label.alias("row_labels"),
        *[F.coalesce(F.sum(name), F.lit(0.0)).alias(f"sum_of_{name}") for name in hours],
    ).drop("ca_name")


def narrow(plans: DataFrame, infill: str | None = None, approval_status: str | None = None) -> DataFrame:
    """Keep one infill flag or approval status; blank means all."""
    for name, value in (("infill", infill), ("approval_status", approval_status)):
        if value is not None and str(value).strip():
            plans = plans.where(F.trim(name) == F.lit(str(value).strip()))
    return plans
