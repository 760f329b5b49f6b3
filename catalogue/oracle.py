"""ANSI SQL for DuckDB, one statement per registered query."""

from __future__ import annotations

# The star views over the raw tables, as common table expressions.
AY = "(year({d}) + 20 - CASE WHEN month({d}) < 8 THEN 1 ELSE 0 END)"


def ay(column: str) -> str:
    return AY.format(d=column)


def label(year: str) -> str:
    return f"(right(CAST({year} AS VARCHAR), 2) || '/' || right(CAST({year} + 1 AS VARCHAR), 2))"


STAR = f"""
WITH RECURSIVE dim_academic_year AS (
  SELECT DISTINCT CAST({ay('l_shipdate')} AS INTEGER) AS academic_year_skey,
         {label(ay('l_shipdate'))} AS academic_year
  FROM lineitem),
dim_provider AS (
  SELECT s_suppkey AS provider_skey, s_name AS provider_name,
         CASE WHEN n_nationkey % 6 = 0 THEN '  ' ELSE n_name END AS contact_town,
         r_name AS college_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
dim_ssa AS (
  SELECT DISTINCT p_type || '|' || p_brand AS ssa_skey,
         CASE WHEN p_type <> 'PROMO' THEN p_type END AS ssa_tier_1_description,
         p_brand AS ssa_tier_2_description
  FROM part WHERE p_type <> 'SMALL'),
dim_level AS (
  SELECT DISTINCT CAST(floor((p_size - 1) / 10.0) AS INTEGER) AS level_skey,
         CASE WHEN p_size <= 40 THEN 'Level ' || CAST(CAST(floor((p_size - 1) / 10.0) AS INTEGER) + 1 AS VARCHAR)
              ELSE '' END AS level_description
  FROM part),
dim_age AS (
  SELECT DISTINCT c_mktsegment AS age_skey,
         CASE c_mktsegment WHEN 'BUILDING' THEN '16-18' WHEN 'MACHINERY' THEN '19-23'
              WHEN 'FURNITURE' THEN '24-30' WHEN 'HOUSEHOLD' THEN '31-49' ELSE '50+' END AS age_group_fes
  FROM customer),
dim_learning_aim AS (
  SELECT p_partkey AS learning_aim_skey,
         CASE WHEN p_partkey % 10 <> 0 THEN 'AIM' || CAST(p_partkey AS VARCHAR) END AS learn_aim_ref,
         CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_name END AS learn_aim_ref_title,
         CASE WHEN p_size % 3 <> 0 THEN 'NVQ' || CAST(p_size % 5 AS VARCHAR) END AS nvq_level_v2,
         'N' || CAST(p_size % 4 AS VARCHAR) AS nvq_level,
         CAST(p_size AS BIGINT) AS guided_learning_hours
  FROM part),
dim_learning_delivery AS (
  SELECT DISTINCT l_returnflag || '|' || l_linestatus || '|' || o_orderpriority AS learning_delivery_skey,
         CASE WHEN o_orderpriority = '5-LOW' THEN ' '
              WHEN l_returnflag = 'A' THEN '16-19 (excluding Apprenticeships)'
              WHEN l_returnflag = 'R' THEN 'Adult skills'
              ELSE 'Apprenticeships (from 1 May 2017)' END AS funding_model,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN 'Programme ' || left(o_orderpriority, 1) END AS programme_type,
         CASE WHEN l_linestatus = 'F' THEN 'REF-' || l_returnflag ELSE '' END AS learning_aim_reference,
         CASE WHEN l_linestatus = 'O' THEN 'Continuing' ELSE ' ' END AS completion_status,
         CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 3 ELSE 9 END AS completion_status_code,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'true' WHEN o_orderpriority <> '3-MEDIUM' THEN 'N' END AS is_non_funded
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dim_learner AS (
  SELECT c_custkey AS learner_skey,
         CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'Campus ' || CAST(c_nationkey AS VARCHAR) END AS campus_identifier,
         CASE WHEN c_custkey % 8 <> 0 THEN c_nationkey END AS campus_id,
         CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 40 END AS planned_eep_hours
  FROM customer),
fact_enrolment AS (
  SELECT o_custkey AS learner_skey, l_suppkey AS provider_skey,
         CAST({ay('l_shipdate')} AS INTEGER) AS academic_year_skey,
         l_partkey AS learning_aim_skey, p_type || '|' || p_brand AS ssa_skey,
         CAST(floor((p_size - 1) / 10.0) AS INTEGER) AS level_skey, c_mktsegment AS age_skey,
         l_returnflag || '|' || l_linestatus || '|' || o_orderpriority AS learning_delivery_skey,
         CASE WHEN l_linenumber <> 7 THEN CAST(1 + l_linenumber % 2 AS BIGINT) END AS enrolment_count,
         CASE WHEN l_quantity < 45 THEN CAST(l_quantity AS BIGINT) END AS guided_learning_hours,
         CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) END AS planned_end_date,
         CAST(l_shipdate AS DATE) AS actual_end_date
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
       LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey),
fact_account AS (
  SELECT l_suppkey AS provider_skey, CAST({ay('l_shipdate')} AS INTEGER) AS academic_year_skey,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS adjusted_income,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.50 AS DECIMAL(18,4))
         + CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.10 AS DECIMAL(18,4))
         + CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4))
         + CAST(l_quantity AS DECIMAL(18,4)) + CAST(1 AS DECIMAL(18,4)) AS all_costs
  FROM lineitem),
enrolled AS (
  SELECT fe.*, ay.academic_year, p.provider_name, p.contact_town, p.college_type,
         coalesce(nullif(trim(p.contact_town), ''), 'Unknown') AS location,
         ld.funding_model, ld.programme_type, ld.learning_aim_reference,
         ssa.ssa_tier_1_description, ssa.ssa_tier_2_description, ssa.ssa_skey AS ssa_member,
         lv.level_description, la.nvq_level_v2, la.nvq_level, la.learn_aim_ref, la.learn_aim_ref_title,
         ag.age_group_fes, 2000 + CAST(left(ay.academic_year, 2) AS INTEGER) AS year,
         coalesce(nullif(trim(ld.funding_model), ''), 'Unknown') AS funding,
         coalesce(nullif(trim(ssa.ssa_tier_1_description), ''), 'Unknown') AS ssa,
         coalesce(nullif(trim(lv.level_description), ''), nullif(trim(la.nvq_level_v2), ''),
                  nullif(trim(la.nvq_level), ''), 'Unknown') AS level,
         CASE WHEN nullif(trim(la.learn_aim_ref_title), '') IS NOT NULL
               AND coalesce(nullif(trim(ld.learning_aim_reference), ''), nullif(trim(la.learn_aim_ref), '')) IS NOT NULL
              THEN trim(la.learn_aim_ref_title) || ' ('
                   || coalesce(nullif(trim(ld.learning_aim_reference), ''), nullif(trim(la.learn_aim_ref), '')) || ')'
              ELSE coalesce(nullif(trim(la.learn_aim_ref_title), ''), nullif(trim(ld.programme_type), ''),
                            nullif(trim(ld.learning_aim_reference), ''), nullif(trim(la.learn_aim_ref), ''), 'Unknown')
              END AS course
  FROM fact_enrolment fe
  JOIN dim_academic_year ay USING (academic_year_skey)
  JOIN dim_provider p USING (provider_skey)
  LEFT JOIN dim_learning_delivery ld USING (learning_delivery_skey)
  LEFT JOIN dim_ssa ssa ON fe.ssa_skey = ssa.ssa_skey
  LEFT JOIN dim_level lv USING (level_skey)
  LEFT JOIN dim_learning_aim la USING (learning_aim_skey)
  LEFT JOIN dim_age ag USING (age_skey)),
trends AS (
  SELECT academic_year, year, count(DISTINCT learner_skey) AS total_learners,
         CAST(sum(enrolment_count) AS BIGINT) AS total_enrolments
  FROM enrolled GROUP BY ALL),
by_ssa AS (
  SELECT academic_year, year, ssa_tier_1_description AS ssa_tier1, count(DISTINCT learner_skey) AS learner_count,
         CAST(sum(enrolment_count) AS BIGINT) AS enrolment_count
  FROM enrolled WHERE ssa_member IS NOT NULL GROUP BY ALL),
by_provider AS (
  SELECT academic_year, year, provider_skey, provider_name, location, college_type,
         count(DISTINCT learner_skey) AS learner_count, CAST(sum(enrolment_count) AS BIGINT) AS enrolment_count
  FROM enrolled GROUP BY ALL)
"""

# Fixed arguments of the registered queries, shared with ``queries.py``.
TOWN = "NATION_7"
FIRST_YEAR, LAST_YEAR = 2015, 2019
SLICE_FUNDING = "Adult skills"
SLICE_SSA = "STANDARD"
SLICE_PROVIDER = 3


def star(select: str, extra: str = "") -> str:
    """``select`` over the star views, with more named queries in ``extra``."""
    return STAR + (", " + extra if extra else "") + "\n" + select


def blank_safe(column: str) -> str:
    return f"coalesce(nullif(trim({column}), ''), 'Unknown')"


IN_YEARS = f"year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}"

ENROLMENT = {
    "enrolment_trends": star("SELECT academic_year, total_learners, total_enrolments FROM trends"),
    "trend_filtered": star(f"""
        SELECT academic_year, count(DISTINCT learner_skey) AS total_learners,
               CAST(sum(enrolment_count) AS BIGINT) AS total_enrolments
        FROM enrolled WHERE {IN_YEARS} AND location = '{TOWN}' GROUP BY academic_year"""),
    "enrolment_by_provider": star("""
        SELECT academic_year, provider_skey, provider_name, location, college_type, learner_count,
               enrolment_count FROM by_provider"""),
    "enrolment_by_ssa": star("SELECT academic_year, ssa_tier1, learner_count, enrolment_count FROM by_ssa"),
    "enrolment_by_age": star("""
        SELECT academic_year, age_group_fes AS age_group, count(DISTINCT learner_skey) AS learner_count
        FROM enrolled WHERE age_skey IN (SELECT age_skey FROM dim_age) GROUP BY ALL"""),
    "enrolment_by_level": star("""
        SELECT academic_year, level_description AS level_desc, count(DISTINCT learner_skey) AS learner_count
        FROM enrolled WHERE level_skey IN (SELECT level_skey FROM dim_level) GROUP BY ALL"""),
    "funding_trends": star("""
        SELECT academic_year, funding AS funding_scheme, count(DISTINCT learner_skey) AS learner_count,
               CAST(sum(enrolment_count) AS BIGINT) AS enrolment_count
        FROM enrolled GROUP BY ALL"""),
    "timeseries_total": star("SELECT academic_year, total_learners AS learner_count, year FROM trends"),
    "timeseries_provider": star("""
        SELECT academic_year, provider_skey, provider_name, learner_count, year FROM by_provider"""),
    "timeseries_ssa": star("SELECT academic_year, ssa_tier1, learner_count, year FROM by_ssa"),
    "forecast_history_filtered": star(f"""
        SELECT academic_year, count(DISTINCT learner_skey) AS learner_count, year
        FROM enrolled
        WHERE {IN_YEARS} AND funding = '{SLICE_FUNDING}' AND ssa = '{SLICE_SSA}' AND level <> ''
        AND level = 'Level 2' GROUP BY academic_year, year"""),
    "ssa_history": star(f"""
        SELECT academic_year, coalesce(ssa_tier_1_description, 'Unknown') AS ssa_tier1,
               count(DISTINCT learner_skey) AS learner_count, year
        FROM enrolled WHERE funding = 'Unknown' GROUP BY ALL"""),
    "dashboard_summary": star("""
        SELECT (SELECT count(DISTINCT learner_skey) FROM enrolled) AS total_learners,
               academic_year AS current_year, trends.total_learners AS current_learners,
               (SELECT count(DISTINCT provider_skey) FROM enrolled) AS provider_count
        FROM trends ORDER BY academic_year DESC LIMIT 1"""),
    "dashboard_summary_empty": """
        SELECT CAST(0 AS BIGINT) AS total_learners, 'N/A' AS current_year,
               CAST(0 AS BIGINT) AS current_learners, count(*) AS provider_count
        FROM supplier WHERE s_name = 'nowhere'""",
    "providers_list": star(f"""
        SELECT DISTINCT provider_skey, provider_name, college_type, location
        FROM enrolled WHERE {IN_YEARS}"""),
    "provider_year_rollup": star("""
        SELECT academic_year, CAST(sum(learner_count) AS BIGINT) AS learner_count
        FROM by_provider GROUP BY academic_year"""),
    "ml_training_set": star("""
        SELECT academic_year, provider_name, college_type AS provider_type,
               ssa_tier_1_description AS ssa_tier1, ssa_tier_2_description AS ssa_tier2,
               level AS qual_level, funding AS funding_type_desc, age_group_fes AS age_group,
               count(DISTINCT learner_skey) AS learner_count
        FROM enrolled GROUP BY ALL"""),
    "ssa_preview": star("""
        SELECT academic_year, ssa_tier1, learner_count, enrolment_count FROM by_ssa
        ORDER BY academic_year NULLS LAST, ssa_tier1 NULLS LAST LIMIT 50"""),
    "provider_preview": star("""
        SELECT academic_year, provider_skey, provider_name, location, college_type, learner_count, enrolment_count
        FROM by_provider ORDER BY academic_year, provider_name, location, provider_skey LIMIT 100"""),
    "bound_sql": star(f"""
        SELECT academic_year, count(DISTINCT learner_skey) AS total_learners
        FROM enrolled WHERE contact_town = '{TOWN}' GROUP BY academic_year"""),
}

OPTIONS = {
    "available_years": star(f"""
        SELECT year AS value, min(academic_year) AS label
        FROM enrolled WHERE location = '{TOWN}' GROUP BY year"""),
    "available_locations": star(f"SELECT DISTINCT location FROM enrolled WHERE {IN_YEARS}"),
    "ssa_list": star("""
        SELECT DISTINCT ssa_tier_1_description AS ssa_tier1, ssa_tier_2_description AS ssa_tier2
        FROM dim_ssa"""),
    "funding_schemes": star(f"""
        SELECT DISTINCT funding AS funding_scheme
        FROM enrolled WHERE {IN_YEARS} AND provider_skey = {SLICE_PROVIDER}"""),
    "college_filter_options": star(f"""
        SELECT DISTINCT 'funding_scheme' AS "filter", funding AS value FROM sliced WHERE ssa = '{SLICE_SSA}' AND level = 'Level 2'
        UNION ALL
        SELECT DISTINCT 'ssa', ssa FROM sliced WHERE funding = '{SLICE_FUNDING}' AND level = 'Level 2'
        UNION ALL
        SELECT DISTINCT 'level', level FROM sliced WHERE funding = '{SLICE_FUNDING}' AND ssa = '{SLICE_SSA}'
        UNION ALL
        SELECT DISTINCT 'course', trim(course) FROM sliced
        WHERE funding = '{SLICE_FUNDING}' AND ssa = '{SLICE_SSA}' AND level = 'Level 2'
        UNION ALL SELECT 'course_requires_college', 'false'""",
        f"sliced AS (SELECT * FROM enrolled WHERE provider_skey = {SLICE_PROVIDER} AND {IN_YEARS})"),
    "college_filter_options_open": star(f"""
        SELECT DISTINCT 'funding_scheme' AS "filter", funding AS value FROM enrolled
        WHERE ssa = '{SLICE_SSA}' AND course = 'red widget (REF-A)'
        UNION ALL
        SELECT DISTINCT 'ssa', ssa FROM enrolled WHERE course = 'red widget (REF-A)'
        UNION ALL
        SELECT DISTINCT 'level', level FROM enrolled WHERE ssa = '{SLICE_SSA}' AND course = 'red widget (REF-A)'
        UNION ALL SELECT 'course_requires_college', 'true'"""),
    "provider_suggest": star("""
        SELECT provider_skey, provider_name,
               (SELECT count(*) FROM present WHERE contains(lower(provider_name), '7')) AS matched_count,
               (SELECT count(*) FROM present) AS total_count
        FROM present WHERE contains(lower(provider_name), '7')
        ORDER BY provider_name, provider_skey LIMIT 12""",
        "present AS (SELECT DISTINCT provider_skey, trim(provider_name) AS provider_name FROM enrolled)"),
}

# -- programme plans ---------------------------------------------------------

PLANS_CTE = """
bounds AS (
  SELECT max(CAST(left(academic_year, 2) AS INTEGER)) AS target
  FROM fact_enrolment JOIN dim_academic_year USING (academic_year_skey)),
account AS (
  SELECT provider_skey, CAST(left(academic_year, 2) AS INTEGER) AS year_key,
         CAST(sum(coalesce(adjusted_income, 0)) AS DECIMAL(28,4)) AS total_income,
         CAST(sum(all_costs) AS DECIMAL(28,4)) AS total_costs
  FROM fact_account JOIN dim_academic_year USING (academic_year_skey), bounds
  WHERE CAST(left(academic_year, 2) AS INTEGER) IN (target, target - 1) GROUP BY 1, 2),
account_share AS (
  SELECT *, CASE WHEN total_income <> 0
    THEN CAST(total_income - total_costs AS DOUBLE) / CAST(total_income AS DOUBLE) END AS contribution_pct
  FROM account),
plan_rows AS (
  SELECT coalesce(ssa.ssa_tier_1_description, 'Unknown') AS ca_name,
         coalesce(ld.programme_type, 'Unknown') AS prog_code,
         coalesce(la.learn_aim_ref_title, ld.programme_type, 'Unknown') AS prog_name,
         coalesce(la.learn_aim_ref, ld.learning_aim_reference, 'Unknown') AS aim,
         coalesce(lv.level_description, la.nvq_level_v2, la.nvq_level, 'Unknown') AS level_desc,
         coalesce(nullif(trim(l.campus_identifier), ''), CAST(l.campus_id AS VARCHAR), 'Unknown') AS site,
         coalesce(ld.learning_aim_reference, la.learn_aim_ref, 'Unknown') AS course_id,
         coalesce(p.provider_name, 'Unknown') AS parent,
         coalesce(nullif(trim(ld.completion_status), ''),
                  CASE ld.completion_status_code WHEN 1 THEN 'Continuing' WHEN 2 THEN 'Completed'
                       WHEN 3 THEN 'Withdrawn' WHEN 6 THEN 'Break in learning' ELSE 'Unknown' END) AS approval_status,
         CASE WHEN upper(coalesce(ld.is_non_funded, 'FALSE')) IN ('TRUE', '1', 'Y', 'YES') THEN 'Y' ELSE 'N' END AS infill,
         fe.start_date, coalesce(fe.planned_end_date, fe.actual_end_date) AS end_date,
         coalesce(fe.guided_learning_hours, la.guided_learning_hours, 0) AS glh,
         coalesce(l.planned_eep_hours, 0) AS eep, coalesce(fe.enrolment_count, 0) AS n,
         CAST(left(ay.academic_year, 2) AS INTEGER) = target AS in_target, ld.funding_model AS fm,
         acc.total_income, acc.total_costs AS acc_costs, acc.contribution_pct AS acc_share
  FROM fact_enrolment fe JOIN dim_academic_year ay USING (academic_year_skey)
  JOIN bounds ON CAST(left(ay.academic_year, 2) AS INTEGER) IN (target, target - 1)
  LEFT JOIN dim_ssa ssa ON fe.ssa_skey = ssa.ssa_skey
  LEFT JOIN dim_learning_aim la ON fe.learning_aim_skey = la.learning_aim_skey
  LEFT JOIN dim_level lv ON fe.level_skey = lv.level_skey
  LEFT JOIN dim_learner l ON fe.learner_skey = l.learner_skey
  LEFT JOIN dim_learning_delivery ld ON fe.learning_delivery_skey = ld.learning_delivery_skey
  LEFT JOIN dim_provider p ON fe.provider_skey = p.provider_skey
  LEFT JOIN account_share acc ON fe.provider_skey = acc.provider_skey
       AND CAST(left(ay.academic_year, 2) AS INTEGER) = acc.year_key),
plans AS (
  SELECT ca_name, prog_code, prog_name, aim, level_desc, site, course_id, min(start_date) AS start_date,
         max(end_date) AS end_date, CAST(sum(glh) AS BIGINT) AS main_qual_glh,
         CAST(0 AS DOUBLE) AS tutorial_hours, CAST(0 AS DOUBLE) AS blended_hours, CAST(0 AS DOUBLE) AS review_hours,
         CAST(sum(eep) AS BIGINT) AS as_hours,
         CAST(sum(CASE WHEN NOT in_target THEN n ELSE 0 END) AS BIGINT) AS groups_2021_22,
         CAST(sum(CASE WHEN in_target THEN n ELSE 0 END) AS BIGINT) AS groups_2022_23,
         CAST(sum(CASE WHEN NOT in_target AND fm = '16-19 (excluding Apprenticeships)' THEN n ELSE 0 END) AS BIGINT) AS actual_16_18_21_22,
         CAST(sum(CASE WHEN NOT in_target AND fm ILIKE '%Adult Skills%' THEN n ELSE 0 END) AS BIGINT) AS aeb_actual_21_22,
         CAST(sum(CASE WHEN NOT in_target AND fm ILIKE '%Apprenticeship%' THEN n ELSE 0 END) AS BIGINT) AS fcr_actual_21_22,
         CAST(sum(CASE WHEN NOT in_target THEN n ELSE 0 END) AS BIGINT) AS total_actual_learners_21_22,
         CAST(sum(CASE WHEN in_target AND fm = '16-19 (excluding Apprenticeships)' THEN n ELSE 0 END) AS BIGINT) AS target_16_18_22_23,
         CAST(sum(CASE WHEN in_target AND fm ILIKE '%Adult Skills%' THEN n ELSE 0 END) AS BIGINT) AS aeb_target_22_23,
         CAST(sum(CASE WHEN in_target THEN n ELSE 0 END) AS BIGINT) AS total_target_learners_22_23,
         CAST(NULL AS VARCHAR) AS cs_risk_rating,
         max(CASE WHEN in_target THEN total_income END) AS total_income_22_23,
         max(CASE WHEN in_target THEN acc_costs END) AS total_costs,
         max(CASE WHEN in_target THEN acc_share END) AS contribution_pct,
         CAST(NULL AS VARCHAR) AS infill_parent_prog_code, parent, approval_status, infill
  FROM plan_rows
  GROUP BY ca_name, prog_code, prog_name, aim, level_desc, site, course_id, parent, approval_status, infill
  HAVING sum(CASE WHEN NOT in_target THEN n ELSE 0 END) > 0 OR sum(CASE WHEN in_target THEN n ELSE 0 END) > 0)"""

DISPLAY = (
    ("ca_name", "CA Name"), ("prog_code", "Prog Code"), ("prog_name", "Prog Name"), ("aim", "Aim"),
    ("level_desc", "Level"), ("site", "Site"), ("course_id", "Course ID"), ("start_date", "Start"),
    ("end_date", "End"), ("main_qual_glh", "Main Qual GLH"), ("tutorial_hours", "Tutorial Hours"),
    ("blended_hours", "Blended Hours"), ("review_hours", "Review Hours"), ("as_hours", "As Hours"),
    ("groups_2021_22", "2021-22 Groups"), ("groups_2022_23", "2022-23 Groups"),
    ("actual_16_18_21_22", "16-18 Actual (21/22)"), ("aeb_actual_21_22", "AEB Actual (21/22)"),
    ("fcr_actual_21_22", "FCR Actual (21/22)"),
    ("total_actual_learners_21_22", "Total Actual Learners (21/22)"),
    ("target_16_18_22_23", "16-18 Target (22/23)"), ("aeb_target_22_23", "AEB Target (22/23)"),
    ("total_target_learners_22_23", "Total Target Learners (22/23)"),
    ("cs_risk_rating", "CS Risk rating"), ("total_income_22_23", "Total Income (22/23)"),
    ("total_costs", "Total Costs"), ("contribution_pct", "Contribution %"),
    ("infill_parent_prog_code", "Infill Parent Prog Code"), ("parent", "Parent"),
    ("approval_status", "Approval Status"), ("infill", "Infill"),
)
DOUBLES = {"tutorial_hours", "blended_hours", "review_hours", "contribution_pct"}


def text_of(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), '')"


PLAN_TEXT_CTE = PLANS_CTE + ", plan_text AS (SELECT " + ", ".join(
    f'{text_of(name)} AS "{shown}"' for name, shown in DISPLAY) + " FROM plans)"
PLAN_SORT = ", ".join(f'"{dict(DISPLAY)[name]}"' for name in (
    "ca_name", "prog_name", "aim", "site", "prog_code", "level_desc", "course_id", "parent",
    "approval_status", "infill"))
ALL_DISPLAY = ", ".join(f'"{shown}"' for _, shown in DISPLAY)
COMPAT = ", ".join(f'"{shown}"' for name, shown in DISPLAY if name != "infill")

SEARCH = "widget"
FILTER_STATUS, FILTER_LEVEL = "Completed", "Level 2"
DEEP_PAGE = 30
MATCHES = ("(" + " OR ".join(f"contains(lower(\"{shown}\"), '{SEARCH}')" for _, shown in DISPLAY)
           + f") AND trim(\"Approval Status\") = '{FILTER_STATUS}' AND trim(\"Level\") = '{FILTER_LEVEL}'")
VALUES_CTE = PLAN_TEXT_CTE + ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{shown}' AS column_name, {i} AS column_position, trim(\"{shown}\") AS value FROM plan_text"
    for i, (_, shown) in enumerate(DISPLAY)) + """),
value_counts AS (
  SELECT column_name, CAST(column_position AS INTEGER) AS column_position,
         count(DISTINCT value) FILTER (WHERE value <> '') AS unique_count
  FROM cells GROUP BY 1, 2)"""


def plan_query(select: str) -> str:
    return star(select, PLANS_CTE)


def text_query(select: str) -> str:
    return star(select, PLAN_TEXT_CTE)


def page_query(page: int, size: int, where: str = "true") -> str:
    """One page in plan order; a page behind the last one means the last one."""
    return text_query(f"""
        SELECT {ALL_DISPLAY} FROM (
          SELECT *, row_number() OVER (ORDER BY {PLAN_SORT}) AS place,
                 (least({page}, greatest(1, CAST(ceil(count(*) OVER () / {size}.0) AS BIGINT))) - 1) * {size} AS first
          FROM plan_text WHERE {where})
        WHERE place > first AND place <= first + {size}""")


def hours(where: str) -> str:
    columns = ("main_qual_glh", "blended_hours", "tutorial_hours")
    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS sum_of_{c}" for c in columns)
    return plan_query(f"""
        SELECT ca_name AS row_labels, {sums} FROM plans WHERE {where} GROUP BY ca_name
        UNION ALL
        SELECT 'Grand Total', {sums} FROM plans WHERE {where} HAVING count(*) > 0""")


PLANS = {
    "year_window": plan_query(
        "SELECT target AS target_year_key, target - 1 AS actual_year_key FROM bounds"),
    "provider_accounts": plan_query(
        "SELECT provider_skey, year_key, total_income, total_costs, contribution_pct FROM account_share"),
    "programme_plans": plan_query("SELECT * FROM plans"),
    "plans_compat": star(
        f"SELECT {COMPAT} FROM display",
        PLANS_CTE + ", display AS (SELECT " + ", ".join(f'{n} AS "{s}"' for n, s in DISPLAY) + " FROM plans)"),
    "plans_hours_summary": hours("true"),
    "plans_hours_filtered": hours("infill = 'Y' AND approval_status = 'Completed'"),
    "plans_snapshot_roundtrip": text_query(f"SELECT {ALL_DISPLAY} FROM plan_text"),
    "plans_csv_roundtrip": text_query(f"SELECT {ALL_DISPLAY} FROM plan_text"),
    "plans_dataset_info": text_query("""
        SELECT 'Programme Plans Dataset' AS name, count(*) AS row_count,
               CAST(31 AS BIGINT) AS column_count, 'snapshot' AS source FROM plan_text"""),
    "plans_filter_values": star(
        "SELECT DISTINCT column_name, value FROM cells WHERE value <> ''", VALUES_CTE),
    "plans_filter_counts": star(
        "SELECT column_name, column_position, unique_count FROM value_counts", VALUES_CTE),
    "plans_quick_filters": star("""
        SELECT column_name, unique_count,
               CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS quick_position
        FROM (SELECT column_name, unique_count,
                CASE WHEN unique_count BETWEEN 1 AND ceiling THEN preferred
                     WHEN unique_count BETWEEN 2 AND 20 THEN 1000 + column_position END AS place
              FROM value_counts LEFT JOIN (VALUES
                ('Approval Status', 25, 0), ('Infill', 12, 1), ('Site', 60, 2), ('Level', 25, 3),
                ('Parent', 30, 4), ('CA Name', 100, 5)) AS q(column_name, ceiling, preferred) USING (column_name))
        WHERE place IS NOT NULL ORDER BY place LIMIT 6""", VALUES_CTE),
    "plans_page": page_query(2, 100),
    "plans_page_deep": page_query(DEEP_PAGE, 250),
    "plans_page_filtered": page_query(2, 20, MATCHES),
    "plans_search": text_query(
        f"SELECT {ALL_DISPLAY} FROM plan_text WHERE " + " OR ".join(
            f"contains(lower(\"{shown}\"), '{SEARCH}')"
            for _, shown in DISPLAY)),
    "plans_page_meta": text_query(f"""
        SELECT page, CAST(50 AS BIGINT) AS page_size, total_rows, total_pages, page > 1 AS has_previous,
               page < total_pages AS has_next, CASE WHEN total_rows > 0 THEN (page - 1) * 50 + 1 ELSE 0 END AS start_row,
               least(page * 50, total_rows) AS end_row
        FROM (SELECT total_rows, total_pages, least(CAST(999999 AS BIGINT), total_pages) AS page
              FROM (SELECT count(*) AS total_rows,
                           greatest(CAST(1 AS BIGINT), CAST(ceil(count(*) / 50.0) AS BIGINT)) AS total_pages
                    FROM plan_text WHERE {MATCHES}))"""),
}

# -- labels and categories ---------------------------------------------------

FUNCTIONS = {
    "academic_year_parse": star("""
        SELECT l_linenumber, l_returnflag, label, CAST(CASE
                 WHEN regexp_full_match(head, '[0-9]+') THEN CAST(head AS INTEGER)
                      + CASE WHEN length(head) = 2 THEN 2000 ELSE 0 END END AS INTEGER) AS start_year,
               CAST(CASE WHEN TRY_CAST(head AS INTEGER) < 100 THEN 2000 + TRY_CAST(head AS INTEGER)
                    ELSE TRY_CAST(head AS INTEGER) END AS INTEGER) AS start_year_key, count(*) AS n
        FROM (SELECT *, trim(split_part(trim(label), '/', 1)) AS head FROM labelled)
        GROUP BY ALL""",
        f"""labelled AS (SELECT l_linenumber, l_returnflag, CASE l_linenumber
               WHEN 1 THEN {label(ay('l_shipdate'))}
               WHEN 2 THEN CAST({ay('l_shipdate')} AS VARCHAR) || '/' || right(CAST({ay('l_shipdate')} + 1 AS VARCHAR), 2)
               WHEN 3 THEN ' ' || {label(ay('l_shipdate'))} || ' '
               WHEN 4 THEN CAST(l_linenumber + 3 AS VARCHAR) || '/8'
               WHEN 5 THEN 'n/a' WHEN 6 THEN ' ' END AS label FROM lineitem)"""),
    "academic_year_format": star(f"""
        SELECT CAST({ay('l_shipdate')} AS INTEGER) AS year, {label(ay('l_shipdate'))} AS academic_year, count(*) AS n
        FROM lineitem GROUP BY ALL"""),
    "normalise_categories": star("""
        SELECT location, funding AS funding_scheme, ssa, level, count(*) AS n FROM enrolled GROUP BY ALL"""),
    "course_label": star("SELECT course, count(*) AS n FROM enrolled GROUP BY course"),
    "ssa_short_labels": star("""
        SELECT ssa_tier1, CASE WHEN length(ssa_tier1) > 25 THEN left(ssa_tier1, 22) || '...' ELSE ssa_tier1 END AS short_label, n
        FROM (SELECT coalesce(ssa_tier_1_description, 'Unknown') || ' ' || funding AS ssa_tier1, count(*) AS n
              FROM enrolled GROUP BY ALL)"""),
    "sanitize_floats": """
        SELECT l_linenumber, l_returnflag, count(*) AS n, count(ratio) AS n_ratio, count(root) AS n_root,
               CAST(sum(CAST(ratio AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS sum_ratio
        FROM (SELECT l_linenumber, l_returnflag,
                CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS ratio,
                CASE WHEN l_quantity - 10 >= 0 THEN sqrt(l_quantity - 10) END AS root FROM lineitem) GROUP BY ALL""",
    "time_features": star("""
        SELECT academic_year, month, year, CAST(month AS INTEGER) AS month_num,
               CAST((month - 1) // 3 + 1 AS INTEGER) AS quarter_num,
               round(sin(2 * pi() * month / 12), 6) AS month_sin, round(cos(2 * pi() * month / 12), 6) AS month_cos, n
        FROM (SELECT academic_year, year, CAST(month(start_date) AS INTEGER) AS month, count(*) AS n
              FROM enrolled GROUP BY ALL)"""),
}

# -- summaries, windows and reshapes -----------------------------------------

SUMMARIES = {
    "enrolment_summary_yoy": star("""
        SELECT academic_year, learner_count, enrolment_count,
               round_even(100.0 * (learner_count - before) / CAST(before AS DOUBLE), 2) AS yoy_change
        FROM (SELECT *, lag(learner_count) OVER (ORDER BY academic_year) AS before
              FROM (SELECT academic_year, CAST(sum(learner_count) AS BIGINT) AS learner_count,
                           CAST(sum(enrolment_count) AS BIGINT) AS enrolment_count FROM by_ssa GROUP BY 1))"""),
    "trend_direction": star("""
        SELECT academic_year, total_learners, total_enrolments, change,
               CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' WHEN change = 0 THEN 'flat' ELSE 'none' END AS direction
        FROM (SELECT academic_year, total_learners, total_enrolments,
                     round_even(100.0 * (total_learners - lag(total_learners) OVER (ORDER BY academic_year))
                       / CAST(lag(total_learners) OVER (ORDER BY academic_year) AS DOUBLE), 1) AS change FROM trends)"""),
    "ssa_share": star("""
        SELECT academic_year, ssa_tier1, learner_count,
               round_even(100.0 * learner_count / CAST(sum(learner_count) OVER (PARTITION BY academic_year) AS DOUBLE), 2) AS percentage
        FROM by_ssa"""),
    "kpi_metrics": star("""
        SELECT CAST((SELECT sum(n) FROM yearly) AS BIGINT) AS total_learners,
               (SELECT n FROM yearly ORDER BY academic_year DESC LIMIT 1) AS current_year_learners,
               (SELECT avg(n) FROM yearly) AS average_per_year,
               (SELECT academic_year FROM yearly ORDER BY n DESC, academic_year LIMIT 1) AS peak_year""",
        "yearly AS (SELECT academic_year, CAST(sum(learner_count) AS BIGINT) AS n FROM by_ssa GROUP BY 1)"),
    "latest_ssa_distribution": star("""
        SELECT academic_year, ssa_tier1, learner_count, enrolment_count FROM by_ssa
        WHERE academic_year = (SELECT max(academic_year) FROM by_ssa)"""),
    "latest_age_level": star("""
        SELECT 'age' AS kind, age_group_fes AS name, count(DISTINCT learner_skey) AS learner_count FROM newest
        WHERE age_group_fes IS NOT NULL GROUP BY ALL
        UNION ALL
        SELECT 'level', level_description, count(DISTINCT learner_skey) FROM newest
        WHERE level_description IS NOT NULL GROUP BY ALL""",
        "newest AS (SELECT * FROM enrolled WHERE academic_year = (SELECT max(academic_year) FROM enrolled))"),
    "series_prepare": star("""
        SELECT provider_type, year, CAST(sum(learner_count) AS BIGINT) AS learner_count
        FROM (SELECT college_type AS provider_type, year, learner_count FROM by_provider) GROUP BY ALL"""),
    "lag_features": star("""
        SELECT provider_skey, year, learner_count,
               lag(learner_count, 1) OVER w AS learner_count_lag_1, lag(learner_count, 2) OVER w AS learner_count_lag_2,
               lag(learner_count, 3) OVER w AS learner_count_lag_3,
               round(avg(learner_count) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS learner_count_rolling_mean_3,
               round(stddev_samp(learner_count) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS learner_count_rolling_std_3
        FROM by_provider WINDOW w AS (PARTITION BY provider_skey ORDER BY year)"""),
    "moving_average": star("""
        SELECT provider_skey, year, learner_count, round(CASE
                 WHEN count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
                 THEN avg(learner_count) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS moving_average
        FROM by_provider WINDOW w AS (PARTITION BY provider_skey ORDER BY year)"""),
    "date_dimension": """
        SELECT CAST(year(d) * 100 + month(d) AS INTEGER) AS date_key, CAST(year(d) AS INTEGER) AS year,
               CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter,
               'Q' || CAST(quarter(d) AS VARCHAR) AS quarter_name,
               CAST(y AS VARCHAR) || '/' || right(CAST(y + 1 AS VARCHAR), 2) AS academic_year,
               CAST(CASE WHEN month(d) = 9 THEN 1 ELSE 0 END AS INTEGER) AS is_academic_start
        FROM (SELECT d, year(d) - CASE WHEN month(d) < 8 THEN 1 ELSE 0 END AS y
              FROM (SELECT unnest(generate_series(
                      make_date(year(min(o_orderdate)), 1, 1), make_date(year(max(o_orderdate)), 12, 1),
                      INTERVAL 1 MONTH)) AS d FROM orders))""",
    "sequence_windows": star("""
        SELECT provider_skey, year, round(x1, 6) AS x_learner_count_1, round(x2, 6) AS x_learner_count_2,
               round(x3, 6) AS x_learner_count_3, round(e1, 6) AS x_enrolment_count_1,
               round(e2, 6) AS x_enrolment_count_2, round(e3, 6) AS x_enrolment_count_3, round(s, 6) AS y
        FROM (SELECT provider_skey, year, s, lag(s, 3) OVER w AS x1, lag(s, 2) OVER w AS x2, lag(s, 1) OVER w AS x3,
                     lag(e, 3) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 1) OVER w AS e3,
                     row_number() OVER w AS position
              FROM (SELECT provider_skey, year,
                       CAST(learner_count - min(learner_count) OVER () AS DOUBLE)
                         / (max(learner_count) OVER () - min(learner_count) OVER ()) AS s,
                       CAST(enrolment_count - min(enrolment_count) OVER () AS DOUBLE)
                         / (max(enrolment_count) OVER () - min(enrolment_count) OVER ()) AS e
                    FROM by_provider)
              WINDOW w AS (PARTITION BY provider_skey ORDER BY year))
        WHERE position > 3"""),
}

FAMILIES = ("ENROLMENT", "OPTIONS", "PLANS", "FUNCTIONS", "SUMMARIES")
