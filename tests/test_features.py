import inspect
import math
import statistics

import numpy as np

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from cohortia.operators import features as fe
from cohortia.session import scratch_path
from cohortia.sources.ordered import read_ordered, with_row_numbers, write_ordered


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-1000, 1000)), min_size=1, max_size=60))
def test_medians_are_exact(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    known = [v for v in values if v is not None]
    assert fe.exact_medians(frame, ["v"])["v"] == (statistics.median(known) if known else None)


@pytest.mark.parametrize("expression", ["id", "pow(id, 3)", "case when id % 3 = 0 then 7 else id end", "id % 2", "sin(id) * 1e9"])
def test_medians_of_many_rows(spark, expression):
    frame = spark.range(60_001).select(F.expr(f"cast({expression} as double)").alias("v"))
    expected = frame.agg(F.median("v")).first()[0]
    assert fe.exact_medians(frame, ["v"])["v"] == expected


def test_modes_take_the_smallest_on_ties(spark):
    frame = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "t string, u string")
    assert fe.modes(frame, ["t", "u"]) == {"t": "a", "u": "Unknown"}


def test_clean_data(spark):
    frame = spark.createDataFrame(
        [(1, "x"), (1, "x"), (2, None), (None, "x"), (4, "y")], "n bigint, t string")
    assert rows_of(fe.clean_data(frame)) == [(1.0, "x"), (2.0, "x"), (2.0, "x"), (4.0, "y")]


def test_nan_is_missing(spark):
    frame = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, 4.0), (5, 9.0)], "k int, v double")
    assert {tuple(r) for r in fe.clean_data(frame).collect()} == {(1, 2.0), (2, 4.0), (3, 4.0), (4, 4.0), (5, 9.0)}
    assert fe.feature_summary(frame).first()["missing_values"] == 2


def test_codes_are_places_in_sorted_order(spark):
    frame = spark.createDataFrame([("b", 10), ("a", 9), (None, 10), ("c", 9)], "t string, n int")
    expected = [("n", "10", 0), ("n", "9", 1), ("t", "None", 0), ("t", "a", 1), ("t", "b", 2), ("t", "c", 3)]
    assert rows_of(fe.label_codes(frame, ["t", "n"])) == expected
    found = fe.encode_categories(frame, ["t", "missing"])
    assert {r.t: r.t_encoded for r in found.collect()} == {None: 0, "a": 1, "b": 2, "c": 3}


def test_row_numbers_follow_the_order(spark):
    frame = spark.range(3000).select(((F.col("id") * 7) % 3000).alias("v"), F.lit("same").alias("t"))
    path = scratch_path(spark, "test-ordered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ordered(frame, ["t", "v"], path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert read_ordered(spark, path).select("part_no").distinct().count() > 1
    found = with_row_numbers(read_ordered(spark, path)).collect()
    assert sorted(r.row_no for r in found) == list(range(3000))
    assert all(r.row_no == r.v for r in found)


def test_split_depends_on_content_only(spark):
    frame = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    train, test = fe.train_test_split(frame, ["k"])
    assert train.count() + test.count() == 2000
    assert math.isclose(train.count() / 2000, 0.8, abs_tol=0.04)
    again, _ = fe.train_test_split(frame.repartition(7), ["k"])
    assert rows_of(train) == rows_of(again)


def test_feature_summary(spark):
    frame = spark.createDataFrame([(1, None, "a"), (None, 2.0, None)], "a int, b double, c string")
    assert tuple(fe.feature_summary(frame).first()) == (2, 3, 2, 1, 3)


def test_medians_of_many_columns_and_distributions(spark):
    rng = np.random.default_rng(8)
    n = 20_001
    columns = {
        "normal": rng.normal(size=n), "tiny_and_huge": np.exp(rng.normal(size=n) * 300), "two": np.repeat([1.0, 2.0], [n // 2, n // 2 + 1]),
        "third": np.where(np.arange(n) % 3 == 0, 5.5, rng.normal(size=n) + 5.5), "signed": np.where(np.arange(n) % 2, -1e300, 1e300) * rng.random(n),
        "one": np.full(n, 3.0), "gap": np.where(np.arange(n) < n // 2, -10.0, 10.0) + rng.random(n), "steps": np.floor(rng.random(n) * 1000)}
    rows = list(zip(*(c.tolist() for c in columns.values())))
    names = list(columns)
    for size in (n, n - 1):
        frame = spark.createDataFrame(rows[:size], ", ".join(f"{c} double" for c in names))
        found = fe.exact_medians(frame, names)
        for c in names:
            assert found[c] == statistics.median(columns[c][:size].tolist()), c


def test_median_of_a_million_values_moves_few_rows(spark):
    frame = spark.range(1_000_001).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    values = np.sort(np.arange(1_000_001) * 7919 % 1_000_003)
    assert fe.exact_medians(frame, ["v"])["v"] == values[500_000]
    assert "Window" not in inspect.getsource(fe)


def test_medians_without_values(spark):
    assert fe.exact_medians(spark.range(3).select(F.lit(None).cast("int").alias("a")), ["a"]) == {"a": None}
    assert fe.exact_medians(spark.range(3), []) == {}
