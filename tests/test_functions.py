import pytest
from pyspark.sql import functions as F

from cohortia.functions import numbers, text, years
from cohortia.operators import summaries


def value_of(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column).first()[0]


@pytest.mark.parametrize("label, start, key", [
    ("23/24", 2023, 2023), ("2023/24", 2023, 2023), (" 23/24 ", 2023, 2023), ("n/a", None, None),
    ("", None, None), (None, None, None), ("7/8", 7, 2007), ("2023", 2023, 2023), ("-5/6", None, 1995),
])
def test_start_years(spark, label, start, key):
    frame = spark.createDataFrame([(label,)], "label string")
    row = frame.select(years.start_year(F.col("label")), years.start_year_key(F.col("label"))).first()
    assert tuple(row) == (start, key)


@pytest.mark.parametrize("year, label", [(2026, "26/27"), (1999, "99/00"), (2009, "09/10"), (2099, "99/00")])
def test_year_labels(spark, year, label):
    assert value_of(spark, years.year_label(F.col("y")), y=year) == label


def test_two_digit_key(spark):
    assert value_of(spark, years.two_digit_key(F.col("l")), l="23/24") == 23
    assert value_of(spark, years.two_digit_key(F.col("l")), l="x/y") is None


@pytest.mark.parametrize("parts, expected", [
    (("Maths", "P1", "R1", "A1"), "Maths (R1)"), ((" Maths ", None, " ", "A1"), "Maths (A1)"),
    (("Maths", "P1", None, ""), "Maths"), ((" ", "P1", "R1", "A1"), "P1"), ((None, "", "R1", "A1"), "R1"),
    ((None, None, None, "A1"), "A1"), ((None, " ", "", None), "Unknown"),
])
def test_course_labels(spark, parts, expected):
    frame = spark.createDataFrame([parts], "t string, p string, r string, a string")
    assert frame.select(text.course_label(*map(F.col, "tpra"))).first()[0] == expected


@pytest.mark.parametrize("status, code, expected", [
    ("Done", 1, "Done"), (" ", 1, "Continuing"), (None, 2, "Completed"), ("", 3, "Withdrawn"),
    (None, 6, "Break in learning"), (None, 9, "Unknown"), (None, None, "Unknown"),
])
def test_completion(spark, status, code, expected):
    frame = spark.createDataFrame([(status, code)], "s string, c int")
    assert frame.select(text.completion_label(F.col("s"), F.col("c"))).first()[0] == expected


@pytest.mark.parametrize("flag, expected", [("true", "Y"), ("1", "Y"), ("yes", "Y"), ("N", "N"), (None, "N"), ("", "N")])
def test_infill(spark, flag, expected):
    frame = spark.createDataFrame([(flag,)], "f string")
    assert frame.select(text.infill_flag(F.col("f"))).first()[0] == expected


def test_site(spark):
    frame = spark.createDataFrame([(" A ", 1), (" ", 1), (None, 2), ("", None)], "i string, c int")
    found = [r[0] for r in frame.select(text.site_label(F.col("i"), F.col("c"))).collect()]
    assert found == ["A", "1", "2", "Unknown"]


def test_short_labels(spark):
    assert value_of(spark, text.short_label(F.col("s")), s="x" * 25) == "x" * 25
    assert value_of(spark, text.short_label(F.col("s")), s="x" * 26) == "x" * 22 + "..."


def test_non_finite_floats_become_null(spark):
    frame = spark.createDataFrame(
        [(1.0, 1), (float("nan"), 2), (float("inf"), 3), (float("-inf"), 4), (None, 5)], "a double, b int")
    assert [r[0] for r in numbers.nulls_for_non_finite(frame).orderBy("b").collect()] == [1.0, None, None, None, None]


SAMPLE = [(y, s, n) for y, a, b in (("2021/22", 1500, 2000), ("2022/23", 1600, 2100), ("2023/24", 1700, 2200))
          for s, n in (("Science", a), ("Business", b))]


@pytest.fixture()
def sample(spark):
    return spark.createDataFrame(SAMPLE, "academic_year string, ssa_tier1 string, learner_count bigint")


def test_summary_of_the_sample(sample):
    found = summaries.enrolment_summary(sample).orderBy("academic_year").collect()
    assert [(r.learner_count, r.yoy_change) for r in found] == [(3500, None), (3700, 5.71), (3900, 5.41)]


def test_shares_of_the_sample(sample):
    found = {(r.academic_year, r.ssa_tier1): r.percentage for r in summaries.ssa_breakdown(sample).collect()}
    assert found[("2021/22", "Science")] == 42.86 and found[("2021/22", "Business")] == 57.14
    assert found[("2022/23", "Science")] == 43.24 and found[("2023/24", "Business")] == 56.41


def test_key_figures_of_the_sample(spark, sample):
    row = summaries.kpi_metrics(sample).first()
    assert tuple(row) == (11100, 3900, 3700.0, "2023/24")
    assert summaries.kpi_metrics(sample, "2021/22").first().current_year_learners == 3500
    assert summaries.kpi_metrics(sample, "1999/00").first().current_year_learners == 0
    assert tuple(summaries.kpi_metrics(sample.limit(0)).first()) == (0, 0, None, "N/A")
    tied = spark.createDataFrame([("b", 5), ("a", 5)], "academic_year string, learner_count bigint")
    assert summaries.kpi_metrics(tied).first().peak_year == "a"


def test_trend_directions(spark):
    trends = spark.createDataFrame(
        [("20/21", 100), ("21/22", 110), ("22/23", 110), ("23/24", 99), ("24/25", 0), ("25/26", 4)],
        "academic_year string, total_learners bigint")
    found = summaries.trend_direction(trends).orderBy("academic_year").collect()
    assert [r.direction for r in found] == ["none", "up", "flat", "down", "down", "none"]
    assert [r.change for r in found] == [None, 10.0, 0.0, -10.0, -100.0, None]


def test_scaling_of_a_constant_column(spark):
    frame = spark.createDataFrame([(1, 3.0), (2, 3.0)], "a int, b double")
    assert [r.b for r in summaries.scale_minmax(frame, ["b"]).collect()] == [0.0, 0.0]
    assert [r.b for r in summaries.scale_standard(frame, ["b"]).collect()] == [0.0, 0.0]
    assert sorted(r.a for r in summaries.scale_standard(frame, ["a"]).collect()) == [-1.0, 1.0]


def test_moving_average_waits_for_a_full_window(spark):
    frame = spark.createDataFrame([("k", y, float(y)) for y in range(1, 5)], "k string, year int, v double")
    found = summaries.moving_average(frame, "v", ["k"]).orderBy("year").collect()
    assert [r.moving_average for r in found] == [None, None, 2.0, 3.0]


def test_lags_and_rolling_values(spark):
    frame = spark.createDataFrame([("k", y, float(v)) for y, v in ((1, 1), (2, 3), (3, 8), (4, 0))], "k string, year int, v double")
    found = summaries.lag_features(frame, "v", ["k"]).orderBy("year").collect()
    assert [r.v_lag_2 for r in found] == [None, None, 1.0, 3.0]
    assert found[0].v_rolling_std_3 is None and found[1].v_rolling_mean_3 == 2.0
    assert found[2].v_rolling_mean_3 == 4.0


def test_dates_start_in_august_and_flag_september(spark):
    bounds = spark.sql("select date'2019-03-05' as first, date'2020-01-01' as last")
    found = {r.date_key: r for r in summaries.date_dimension(bounds).collect()}
    assert len(found) == 24 and min(found) == 201901 and max(found) == 202012
    assert found[201907].academic_year == "2018/19" and found[201908].academic_year == "2019/20"
    assert found[201909].is_academic_start == 1 and found[201908].is_academic_start == 0
    assert found[201912].month_name == "December" and found[201912].quarter_name == "Q4"


def test_pivot_fills_gaps_and_rounds_half_to_even(spark):
    frame = spark.createDataFrame(
        [("A", "24/25", 2.5), ("A", "25/26", 3.5), ("B", "25/26", 1.2)],
        "ssa_tier1 string, academic_year string, predicted_enrolments double")
    found = {r[0]: tuple(r)[1:] for r in summaries.pivot_years(frame, ["24/25", "25/26"]).collect()}
    assert found == {"A": (2, 4), "B": (0, 1)}


def test_export_matches_columns_by_name(spark):
    history = spark.createDataFrame([(2024, 10.0)], "year int, learner_count double")
    forecast = spark.createDataFrame([(12.0, 2025, "x")], "predicted_learner_count double, year int, trend string")
    found = summaries.combine_for_export(history, forecast, "learner_count").orderBy("year").collect()
    assert [(r.learner_count, r.data_type, r.trend) for r in found] == [
        (10.0, "Historical", None), (12.0, "Forecast", "x")]
