"""Plans keep their shape, and results hold when nothing is small enough to broadcast."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import FOLDER, rows_of
from cohortia.forecasting.arima import arima
from cohortia.forecasting.series import to_series
from cohortia.operators import enrolment as en
from cohortia.operators.filters import FilterSet
from cohortia.plans import programme as pg


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "enrolment_trends", "trend_filtered", "enrolment_by_provider", "enrolment_by_ssa", "enrolment_by_age",
    "enrolment_by_level", "funding_trends", "forecast_history_filtered", "ssa_history", "dashboard_summary",
    "providers_list", "college_filter_options", "provider_accounts", "programme_plans", "plans_hours_summary",
    "plans_filter_values", "forecast_arima", "ssa_forecast", "compare_models", "forecast_backtest",
    "scale_standard", "lag_features", "ml_training_set",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python_in_the_plan(spark, name):
    text = plan_of(contract.queries()[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text, bad


@pytest.fixture()
def nothing_small(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["programme_plans", "ssa_history", "ml_training_set", "dashboard_summary"])
def test_sort_merge_joins_give_the_same(spark, nothing_small, name):
    merged = rows_of(contract.queries()[name](spark, FOLDER))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert merged == rows_of(contract.queries()[name](spark, FOLDER))


def test_trend_reads_four_columns_and_meets_the_orders_once(spark, star, nothing_small):
    text = plan_of(en.enrolment_trends(star))
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert set(re.search(r"ReadSchema: struct<(.*?)>?$", scan).group(1).replace("...", "").split(",")[0].split(":")) & {
        "l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate"}
    assert "l_extendedprice" not in scan and "customer.parquet" not in text and "part.parquet" not in text
    assert text.count("orders.parquet") == 1


def test_year_range_reaches_the_scan(star):
    text = plan_of(en.enrolment_trends(star, FilterSet.of(start_year=2016, end_year=2018)))
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert re.search(r"PushedFilters: \[[^\]]*l_shipdate", scan)


def test_totals_do_not_join_what_they_do_not_need(star):
    text = plan_of(en.providers_list(star))
    assert "orders.parquet" not in text and "part.parquet" not in text


def test_lines_meet_every_raw_table_once(star, nothing_small):
    text = plan_of(pg.programme_plans(star))
    assert text.count("Exchange hashpartitioning(l_orderkey") == 2  # the lines and the orders
    assert text.count("orders.parquet") == 1
    assert text.count("customer.parquet") == 1


def test_one_key_with_a_third_of_all_rows(spark):
    """A hot key costs no more than one row per year once it is aggregated."""
    facts = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("provider_skey"),
        (F.col("id") % 10 + 2010).cast("int").alias("year"), F.col("id").alias("learner_skey"))
    counts = facts.groupBy("provider_skey", "year").agg(F.count_distinct("learner_skey").alias("learner_count"))
    series = to_series(counts, ["provider_skey"])
    assert series.agg(F.max(F.size("y"))).first()[0] <= 10
    hot = series.where("provider_skey = 0").first()
    assert sum(hot.y) == 30_000 + facts.where("provider_skey = 0 and learner_skey % 3 <> 0").count()
    assert arima(series).count() == series.count()
