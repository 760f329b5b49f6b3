"""Regression models on the encoded training frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators.linear import LinearFit, Moments
from cohortia.operators.trees import Bins, Boosting, Forest, Trees
from cohortia.session import shuffle_width

RIDGE_ALPHA, LASSO_ALPHA = 1.0, 0.1
TREES, BOOSTING_ROUNDS, SEED = 100, 100, 42
FOREST_DEPTH, BOOSTING_DEPTH, BOOSTING_STEP = 10, 3, 0.1
FEWEST_PARTS, ROWS_A_PART = 8, 1_000_000  # partitions of the training rows, unless a shuffle has fewer

LINEAR, RIDGE, LASSO = "Linear Regression", "Ridge Regression", "Lasso Regression"
FOREST, BOOSTING = "Random Forest", "Gradient Boosting"


PENALTIES = {LINEAR: {}, RIDGE: {"ridge": RIDGE_ALPHA}, LASSO: {"lasso": LASSO_ALPHA}}


def trees(bins: Bins, forest_depth: int = FOREST_DEPTH) -> dict[str, Forest | Boosting]:
    return {
        FOREST: Forest(bins, TREES, forest_depth, SEED),
        BOOSTING: Boosting(bins, BOOSTING_ROUNDS, BOOSTING_DEPTH, BOOSTING_STEP),
    }


@dataclass
class Regressions:
    """Models fitted on one training frame."""

    features: list[str]
    target: str = "learner_count"
    models: dict[str, Trees | LinearFit] = field(default_factory=dict)
    best: str | None = None
    forest_depth: int = FOREST_DEPTH

    def vectors(self, df: DataFrame) -> DataFrame:
        numbers = df.withColumns({c: F.col(c).cast("double") for c in (*self.features, self.target)})
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(numbers)

    def fit(self, train: DataFrame, names: list[str] | None = None) -> Regressions:
        wanted = set(names or [*PENALTIES, FOREST, BOOSTING])
        if wanted & set(PENALTIES):
            moments = Moments.of(train, self.features, self.target)  # one pass for all linear models
            self.models |= {name: LinearFit.of(moments, self.features, **penalty)
                            for name, penalty in PENALTIES.items() if name in wanted}
        if not wanted - set(PENALTIES):
            return self
        # Hundreds of passes follow: over cells of equal bins, counted once. Each pass sends sums for every partition,
        # so there are no more of them than the rows are worth.
        bins = Bins.of(train, self.features, self.target)
        width = min(shuffle_width(train.sparkSession), max(FEWEST_PARTS, 1 + bins.rows // ROWS_A_PART))
        cells = bins.cells(train, self.target, width).persist()
        try:
            for name, estimator in trees(bins, self.forest_depth).items():
                if name in wanted:
                    self.models[name] = estimator.fit(cells)
        finally:
            cells.unpersist()
        return self

    def compare(self, test: DataFrame) -> DataFrame:
        """Errors of every model on the test rows; the lowest RMSE is the best model."""
        rows = self.vectors(test).select("features", self.target, *self.features).persist()
        try:
            results = []
            for name, model in self.models.items():
                actual, error = F.col(self.target), F.col(self.target) - F.col("prediction")
                results.append((name, *model.transform(rows).agg(
                    F.avg(F.abs(error)), F.sqrt(F.avg(error * error)),
                    1 - F.try_divide(F.sum(error * error), F.var_pop(actual) * F.count("*")),
                    F.avg(F.abs(F.try_divide(error, actual))) * 100).first()))
        finally:
            rows.unpersist()
        self.best = min(results, key=lambda row: row[2])[0]
        return test.sparkSession.createDataFrame(
            [(*row, row[0] == self.best) for row in results],
            "model string, mae double, rmse double, r2 double, mape double, is_best boolean")

    def coefficients(self, spark) -> DataFrame:
        """Weights of the linear models, the intercept among them."""
        rows = [(name, feature, float(value)) for name, model in self.models.items() if isinstance(model, LinearFit)
                for feature, value in [("intercept", model.intercept), *zip(model.features, model.coefficients)]]
        return spark.createDataFrame(rows, "model string, feature string, coefficient double")

    def importance(self, spark) -> DataFrame:
        """Feature importances of the tree models, largest first."""
        rows = [
            (name, feature, float(value))
            for name, model in self.models.items() if hasattr(model, "featureImportances")
            for feature, value in zip(self.features, model.featureImportances.toArray())]
        return spark.createDataFrame(rows, "model string, feature string, importance double").orderBy(
            "model", F.desc("importance"))

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Adds ``prediction`` from a named model, or the best one."""
        model = self.models.get(name or "") or self.models[self.best or next(iter(self.models))]
        return model.transform(self.vectors(df)).drop("features")
