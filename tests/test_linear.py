"""Linear models against numpy and against the conditions of optimality."""

import numpy as np
import pytest

from cohortia.operators import regression
from cohortia.operators.linear import LinearFit, Moments, descended, eliminated, violation
from cohortia.operators.regression import LASSO, LINEAR, RIDGE, Regressions


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5)) * [1, 3, 10, 0.2, 1] + [0, 5, 2000, 1, 0]
    x[:, 4] = 0.97 * x[:, 0] + 0.1 * x[:, 4]
    return x, 3 + x @ [2, 0, 0.5, -4, 0] + rng.normal(size=500)


def frame(spark, x, y):
    names = ", ".join(f"f{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], f"{names}, learner_count double")


def test_linear_and_ridge_are_the_closed_forms(spark, data):
    x, y = data
    names = [f"f{i}" for i in range(5)]
    moments = Moments.of(frame(spark, x, y).repartition(7), names, "learner_count")
    xc, yc = x - x.mean(0), y - y.mean()
    for ridge in (0.0, 1.0, 50.0):
        fit = LinearFit.of(moments, names, ridge=ridge)
        wanted = np.linalg.solve(xc.T @ xc + ridge * np.eye(5), xc.T @ yc)
        assert np.allclose(fit.coefficients, wanted, atol=1e-8)
        assert abs(fit.intercept - (y.mean() - wanted @ x.mean(0))) < 1e-6


def test_lasso_is_optimal_and_sparse(spark, data):
    x, y = data
    names = [f"f{i}" for i in range(5)]
    moments = Moments.of(frame(spark, x, y), names, "learner_count")
    square, right = [r[:5] for r in moments.covariances[:5]], moments.covariances[5][:5]
    for penalty in (0.01, 0.1, 1.0, 1e6):
        weights = descended(square, right, penalty, moments.covariances[5][5])
        assert violation(square, right, weights, penalty) < 1e-9 * max(1, penalty)
    assert weights == [0.0] * 5
    assert 0.0 in LinearFit.of(moments, names, lasso=1.0).coefficients


def test_dependent_and_constant_columns_and_missing_values(spark, data):
    x, y = data
    wide = np.column_stack([x[:, :2], x[:, 0] * 2 + x[:, 1], np.full(len(x), 7.0)])
    rows = frame(spark, wide, y).unionByName(frame(spark, wide[:3] * 99, y[:3]).withColumn("f1", __import__("pyspark").sql.functions.lit(None).cast("double")))
    names = [f"f{i}" for i in range(4)]
    moments = Moments.of(rows, names, "learner_count")
    assert moments.count == 500
    fit = LinearFit.of(moments, names)
    assert fit.coefficients[2:] == [0.0, 0.0]
    best = np.linalg.lstsq(np.column_stack([wide, np.ones(500)]), y, rcond=None)[0]
    predicted = np.array([r.prediction for r in fit.transform(frame(spark, wide, y)).collect()])
    assert np.allclose(np.sort(predicted), np.sort(wide @ best[:4] + best[4]), atol=1e-6)
    assert eliminated([[0.0]], [0.0]) == [0.0]


def test_no_rows(spark, data):
    x, y = data
    fit = LinearFit.of(Moments.of(frame(spark, x, y).limit(0), ["f0"], "learner_count"), ["f0"])
    assert (fit.coefficients, fit.intercept) == ([0.0], 0.0)


def test_models_compare_and_predict_by_name(spark, data):
    rows = frame(spark, *data)
    models = Regressions([f"f{i}" for i in range(5)]).fit(rows, [LINEAR, RIDGE, LASSO])
    found = {r.model: r for r in models.compare(rows).collect()}
    assert found[LINEAR].is_best and found[LINEAR].rmse <= found[RIDGE].rmse <= found[LASSO].rmse
    assert models.predict(rows, LASSO).columns == [*rows.columns, "prediction"]
    assert models.coefficients(spark).count() == 18


def test_trees_get_no_more_partitions_than_the_rows_are_worth(spark, monkeypatch):
    """Each of hundreds of passes sends histograms for every partition."""
    seen = []

    class Spy:
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())

    monkeypatch.setattr(regression, "trees", lambda *_: {regression.BOOSTING: Spy()})
    monkeypatch.setattr(regression, "ROWS_A_PART", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for n in (50, 1950, 100_000):
            train = spark.range(n).selectExpr("id AS x", "id % 3 AS learner_count")
            regression.Regressions(["x"]).fit(train, [regression.BOOSTING])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [8, 20, 64]


def test_covariances_far_from_zero(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2)) + [1e9, -1e9]
    rows = spark.createDataFrame([(float(a), float(b), float(a - 2 * b)) for a, b in x] + [(None, 1.0, 1.0)], "a double, b double, y double")
    found = Moments.of(rows, ["a", "b"], "y")
    full = np.column_stack([x, x[:, 0] - 2 * x[:, 1]])
    assert found.count == 500 and np.allclose(found.means, full.mean(axis=0), rtol=1e-12)
    assert np.allclose(found.covariances, np.cov(full.T, bias=True), atol=1e-5)
