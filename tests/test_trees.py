"""Trees over counted cells against Spark's own, and what must not change them."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from cohortia.operators import regression, trees
from cohortia.operators.regression import BOOSTING, FOREST, LINEAR, Regressions
from cohortia.operators.trees import Bins, Boosting, Forest

NAMES = [f"f{i}" for i in range(4)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = np.column_stack([rng.integers(0, 200, n), rng.integers(0, 5, n), rng.normal(size=n), rng.integers(0, 2, n)])
    y = np.round(3 * (x[:, 0] > 77) + x[:, 1] * x[:, 3] + x[:, 2] ** 2 + rng.normal(size=n), 1)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], ", ".join(f"{c} double" for c in [*NAMES, "y"]))
    yield df.persist()
    df.unpersist()


def cells_of(df, width=5):
    bins = Bins.of(df, NAMES, "y")
    return bins, bins.cells(df, "y", width).persist()


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).select("prediction").collect()])


def test_boosting_is_that_of_spark(rows):
    bins, cells = cells_of(rows)
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    mine = Boosting(bins, 6, 3, 0.1).fit(cells)
    spark_s = GBTRegressor(labelCol="y", maxIter=6, maxDepth=3, stepSize=0.1, seed=1).fit(vectors)
    assert np.allclose(predictions(mine, rows), predictions(spark_s, vectors), atol=1e-9)
    assert np.allclose(mine.featureImportances.toArray(), spark_s.featureImportances.toArray(), atol=1e-9)


def test_forest_is_like_that_of_spark(rows):
    bins, cells = cells_of(rows)
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    mine = Forest(bins, 40, 5, 3).fit(cells)
    spark_s = RandomForestRegressor(labelCol="y", numTrees=40, maxDepth=5, seed=1).fit(vectors)
    ours, theirs, y = predictions(mine, rows), predictions(spark_s, vectors), np.array([r.y for r in rows.collect()])
    error = [np.sqrt(((p - y) ** 2).mean()) for p in (ours, theirs)]
    assert abs(error[0] - error[1]) < 0.05 and np.corrcoef(ours, theirs)[0, 1] > 0.98
    assert np.abs(mine.featureImportances.toArray() - spark_s.featureImportances.toArray()).max() < 0.08
    assert 0.9 < sum(len(t[0]) for t in mine.trees) / spark_s.totalNumNodes < 1.1


def test_passes_go_over_cells_and_repeats_count(spark, rows):
    """Many rows of few cells: 40,000 rows are 30 cells, and weigh as much as the rows."""
    many = spark.range(40_000).select(*((F.col("id") % k).cast("double").alias(c) for k, c in zip((5, 3, 2, 1), NAMES)),
                                      F.pmod(F.col("id"), F.lit(5)).cast("double").alias("y"))
    bins, cells = cells_of(many)
    assert cells.count() == 30 and cells.agg(F.sum("n")).first()[0] == bins.rows == 40_000
    for model in (Forest(bins, 5, 4, 3).fit(cells), Boosting(bins, 3, 3, 0.1).fit(cells)):
        assert len(model.trees) in (5, 3) and model.featureImportances[0] > 0.9
        assert abs(predictions(model, many.limit(2000)).mean() - 2) < 0.05


def test_draws_do_not_depend_on_how_rows_lie(rows):
    found = []
    for df in (rows.repartition(3), rows.repartition(7)):
        bins, cells = cells_of(df)
        found.append(Forest(bins, 8, 4, 3).fit(cells).trees)
    for a, b in zip(*found):
        assert all(np.array_equal(x, y) for x, y in zip(a[:3], b[:3])) and np.allclose(a[3], b[3])


def test_trees_take_turns_beyond_a_number_of_sums(rows, monkeypatch):
    bins, cells = cells_of(rows)
    whole = Forest(bins, 6, 4, 3).fit(cells)
    monkeypatch.setattr(trees, "MOST_SUMS", 300)
    turns = Forest(bins, 6, 4, 3).fit(cells)
    assert all(np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) for a, b in zip(whole.trees, turns.trees))


def test_cuts_of_many_values_are_of_about_equal_shares(rows, monkeypatch):
    exact = Bins.of(rows, NAMES, "y")
    monkeypatch.setattr(trees, "MOST_VALUES", 100)
    cut = Bins.of(rows, NAMES, "y")
    values = np.sort([r.f2 for r in rows.collect()])
    assert [len(c) for c in cut.cuts] == [len(c) for c in exact.cuts] == [31, 4, 31, 1]
    for cuts in (exact.cuts[2], cut.cuts[2]):
        sizes = np.diff(np.concatenate([[0], np.searchsorted(values, cuts), [len(values)]]))
        assert sizes.min() > 60 and sizes.max() < 130


def test_draws_are_poisson():
    table = trees.draw_table().reshape(trees.MOST_IN_TABLE, -1).astype(float)
    n = np.arange(1, trees.MOST_IN_TABLE + 1)
    assert np.allclose(table.mean(1), n, rtol=1e-3) and np.allclose(table.var(1), n, rtol=2e-3)


def test_cells_of_more_rows_than_the_table_holds(spark):
    rows = spark.range(60_000).select(*((F.col("id") % k).cast("double").alias(c) for k, c in zip((2, 1, 1, 1), NAMES)),
                                      F.expr("id % 2 + id % 3").cast("double").alias("y"))
    bins, cells = cells_of(rows, 2)
    model = Forest(bins, 20, 2, 3).fit(cells)
    assert [t[3][0] for t in model.trees] != [model.trees[0][3][0]] * 20  # other rows for each tree
    split = [t[3] + model.base for t in model.trees if len(t[0]) > 1]
    assert split and np.allclose(split, [[1.5, 1, 2]] * len(split), atol=0.05)


def test_missing_values_and_no_rows_raise(spark, rows):
    for bad in (rows.withColumn("f1", F.when(F.col("f0") > 3, F.col("f1"))), rows.withColumn("y", F.lit(float("nan"))), rows.limit(0)):
        with pytest.raises(ValueError):
            Regressions(NAMES, "y").fit(bad, [FOREST])


def test_trees_compare_beside_linear_models(spark, rows, monkeypatch):
    monkeypatch.setattr(regression, "TREES", 10)
    monkeypatch.setattr(regression, "BOOSTING_ROUNDS", 10)
    models = Regressions(NAMES, "y", forest_depth=4).fit(rows, [LINEAR, FOREST, BOOSTING])
    found = {r.model: r for r in models.compare(rows).collect()}
    y = np.array([r.y for r in rows.collect()])
    for name in (FOREST, BOOSTING):
        assert abs(found[name].rmse - np.sqrt(((predictions(models.models[name], rows) - y) ** 2).mean())) < 1e-9
        assert found[name].rmse < found[LINEAR].rmse
    importance = models.importance(spark).collect()
    assert len(importance) == 8 and abs(sum(r.importance for r in importance) - 2) < 1e-9
