import duckdb
import pytest
from pyspark.sql import functions as F

from check_queries import TABLES, compare
from conftest import FOLDER, rows_of
from cohortia.operators import enrolment as en
from cohortia.operators import options as op
from cohortia.operators.filters import FilterSet
from cohortia.plans import programme as pg
from cohortia.session import scratch_path
from cohortia.sources import tables
from cohortia.sources.star import DIMENSION_KEYS, ENROLMENT_COLUMNS, Star, run_sql, store_star


@pytest.fixture(scope="module")
def stored(spark):
    return store_star(tables.table_star(spark, FOLDER), scratch_path(spark, "test-star"))


SLICES = {
    "trend": lambda s: en.enrolment_trends(s, FilterSet.of(start_year=2016, end_year=2018, location="NATION_7")),
    "provider": en.enrolment_by_provider,
    "ssa": en.enrolment_by_ssa,
    "age": en.enrolment_by_age,
    "level": en.enrolment_by_level,
    "ssa history": lambda s: en.ssa_history(s, FilterSet.of(course="red widget (REF-A)")),
    "options": lambda s: op.college_filter_options(s, FilterSet.of(provider_id=3, ssa="STANDARD")),
    "summary": en.dashboard_summary,
    "accounts": pg.provider_accounts,
    "plans": pg.programme_plans,
}


@pytest.mark.parametrize("name", SLICES)
def test_stored_star_gives_the_same(star, stored, name):
    assert rows_of(SLICES[name](stored)) == rows_of(SLICES[name](star))


def test_fact_has_one_row_per_line(star):
    fact = star.enrolments(ENROLMENT_COLUMNS)
    assert tuple(fact.columns) == ENROLMENT_COLUMNS
    assert fact.count() == star.table("lineitem").count()


def test_keys_are_unique_in_their_dimension(star):
    for name, key in DIMENSION_KEYS.items():
        dim = star.dim(name)
        assert dim.count() == dim.select(key).distinct().count(), name


def test_members_come_from_the_data(spark, folder):
    """New segments, size bands, flags, priorities and far years count, as the SQL has it."""
    for name in TABLES:
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name == "customer":
            df = df.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "NEW").otherwise(F.col("c_mktsegment")))
        if name == "part":
            df = df.withColumn("p_size", F.col("p_size") + 10)
        if name == "orders":
            df = df.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "6-NONE").otherwise(F.col("o_orderpriority")))
        if name == "lineitem":
            df = df.withColumn("l_returnflag", F.when(F.col("l_linenumber") == 1, "X").otherwise(F.col("l_returnflag")))
            far = F.col("l_shipdate") + F.expr("make_ym_interval(90, 0)")
            df = df.withColumn("l_shipdate", F.when(F.col("l_linenumber") == 2, far).otherwise(F.col("l_shipdate")))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    for name in ("enrolment_by_age", "enrolment_by_level", "funding_trends", "enrolment_trends"):
        problem, count, _ = compare(spark, connection, folder, name)
        assert (problem, count > 0) == ("", True), name


@pytest.fixture(scope="module")
def small(spark):
    """A star with missing members, blank names and a learner at two providers."""
    root = scratch_path(spark, "test-small")

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}")

    put("dim_academic_year", [(1, "22/23"), (2, "23/24"), (3, "n/a")], "academic_year_skey int, academic_year string")
    put("dim_provider", [(1, "A", "Leeds", "x"), (2, "B", " ", "y")],
        "provider_skey bigint, provider_name string, contact_town string, college_type string")
    put("dim_ssa", [("s", "Science", "t"), ("b", " ", "t")],
        "ssa_skey string, ssa_tier_1_description string, ssa_tier_2_description string")
    put("dim_level", [(1, "")], "level_skey int, level_description string")
    put("dim_age", [("a", "16-18")], "age_skey string, age_group_fes string")
    put("dim_learning_delivery", [("d", "Adult skills", "P", "R")],
        "learning_delivery_skey string, funding_model string, programme_type string, learning_aim_reference string")
    put("dim_learning_aim", [(1, "AIM1", "Maths", None, "N1")],
        "learning_aim_skey bigint, learn_aim_ref string, learn_aim_ref_title string, nvq_level_v2 string, nvq_level string")
    columns = ("learner_skey bigint, provider_skey bigint, academic_year_skey int, learning_aim_skey bigint, "
               "ssa_skey string, level_skey int, age_skey string, learning_delivery_skey string, enrolment_count bigint")
    put("fact_enrolment", [
        (1, 1, 1, 1, "s", 1, "a", "d", 1), (1, 2, 1, 1, "s", 1, "a", "d", None), (2, 2, 2, 9, "?", 9, "?", "?", 3),
        (3, 9, 2, 1, "s", 1, "a", "d", 1), (4, 1, 9, 1, "s", 1, "a", "d", 1), (5, 1, 3, 1, "b", 1, "a", None, 2),
        (None, 1, 2, 1, "b", 1, "a", "d", 5)], columns)
    return Star(spark, root)


def test_missing_years_and_providers_drop_out(small):
    assert rows_of(en.enrolment_trends(small)) == [("22/23", 1, 1), ("23/24", 1, 8), ("n/a", 1, 2)]


def test_missing_members_drop_out_of_inner_breakdowns_only(small):
    assert rows_of(en.enrolment_by_ssa(small)) == [
        ("22/23", "Science", 1, 1), ("23/24", " ", 0, 5), ("n/a", " ", 1, 2)]
    assert rows_of(en.ssa_history(small)) == [
        ("22/23", "Science", 1, 2022), ("23/24", " ", 0, 2023), ("23/24", "Unknown", 1, 2023)]


def test_learner_at_two_providers_counts_twice_in_the_rollup(small):
    assert dict(rows_of(en.provider_year_rollup(small)))["22/23"] == 2


def test_summary(small):
    assert rows_of(en.dashboard_summary(small)) == [(3, "n/a", 1, 2)]
    assert rows_of(en.dashboard_summary(small, FilterSet.of(end_year=2023))) == [(2, "23/24", 1, 2)]
    assert rows_of(en.dashboard_summary(small, FilterSet.of(location="nowhere"))) == [(0, "N/A", 0, 0)]


def test_level_falls_back_and_blank_counts_as_missing(small):
    found = op.college_filter_options(small, FilterSet.of(provider_id=1))
    values = {}
    for r in found.collect():
        values.setdefault(r["filter"], set()).add(r["value"])
    assert values == {
        "funding_scheme": {"Adult skills", "Unknown"}, "ssa": {"Science", "Unknown"}, "level": {"N1"},
        "course": {"Maths (R)", "Maths (AIM1)"}, "course_requires_college": {"false"}}
    without = {r["filter"] for r in op.college_filter_options(small).collect()}
    assert without == {"funding_scheme", "ssa", "level", "course_requires_college"}


def test_each_option_list_ignores_its_own_filter(small):
    found = op.college_filter_options(small, FilterSet.of(provider_id=1, ssa="Science", funding_scheme="Unknown"))
    values = {(r["filter"], r["value"]) for r in found.collect()}
    assert ("funding_scheme", "Adult skills") in values and ("ssa", "Unknown") in values
    assert not {name for name, _ in values} & {"level", "course"}


def test_unlabelled_years_are_no_options(small):
    assert rows_of(op.available_years(small)) == [(2022, "22/23"), (2023, "23/24")]
    assert rows_of(op.available_locations(small)) == [("Leeds",), ("Unknown",)]


def test_suggestions(small):
    assert rows_of(op.suggest_providers(small, " a ")) == [(1, "A", 1, 2)]
    assert op.suggest_providers(small, "").count() == 2
    assert op.suggest_providers(small, "zzz").count() == 0


def test_bound_parameters_are_data(star):
    text = "SELECT count(*) AS n FROM dim_provider WHERE contact_town = :town"
    assert run_sql(star, text, town="x' OR '1'='1").first().n == 0
    town = star.dim("dim_provider").agg(F.max("contact_town")).first()[0]
    assert run_sql(star, text, town=town).first().n > 0


class MovedStar(tables.TableStar):
    """The raw tables with other lines."""

    moved = ""

    def path(self, name: str) -> str:
        return self.moved if name == "lineitem" else super().path(name)


def test_plan_years_of_another_century(spark, folder):
    """The window follows the labels; its members come from the years that are enrolled."""
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    year = F.when(F.col("l_linenumber") % 2 == 0, F.lit(1977)).otherwise(F.lit(1978))  # 97/98 and 98/99
    moved = lines.withColumn("l_shipdate", F.make_date(year, F.lit(9), F.lit(1)).cast("timestamp_ntz"))
    moved = moved.withColumn("l_shipdate", F.when(F.col("l_suppkey") == 1, F.lit(None)).otherwise(F.col("l_shipdate")))
    moved.write.parquet(f"{folder}/moved")
    star = MovedStar(spark, FOLDER)
    star.moved = f"{folder}/moved"
    assert tuple(pg.year_window(star).first()) == (98, 97)
    plans = pg.programme_plans(star).agg(F.sum("groups_2021_22"), F.sum("groups_2022_23")).first()
    count = F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") % 2 + 1)
    wanted = moved.where("l_shipdate IS NOT NULL").groupBy(F.col("l_linenumber") % 2).agg(F.sum(count)).orderBy(F.col("(l_linenumber % 2)")).collect()
    assert tuple(plans) == tuple(r[1] for r in wanted)
    assert {r.year_key for r in pg.provider_accounts(star).select("year_key").distinct().collect()} == {97, 98}
