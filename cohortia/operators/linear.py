"""Linear, ridge and lasso regression from means and covariances, which two aggregations find.

What reaches the driver is a square of as many numbers as there are columns, whatever the number of
rows. Ridge takes its penalty on the sum of squares, lasso on half of the mean square. Rows
with a missing value take no part; a column that follows from those before it gets the weight 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPENDENT = 1e-10  # share of a column's variance that the columns before it must leave
STILL = 1e-13      # largest move of a sweep, as a share of the target's deviation, that ends the descent
SWEEPS = 100_000


@dataclass
class Moments:
    """Rows, means and covariances (population) of the features and, last, of the target."""

    count: int
    means: list[float]
    covariances: list[list[float]]

    @classmethod
    def of(cls, rows: DataFrame, features: list[str], target: str) -> Moments:
        names = [*features, target]
        numbers = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names))).dropna()
        size = range(len(names))
        found = numbers.agg(F.count("*"), *(F.avg(f"c{i}") for i in size)).first()
        means = [v or 0.0 for v in found[1:]]
        # Products of what is left of the means: plain sums, many times as fast as running covariances.
        left = numbers.select(*((F.col(f"c{i}") - F.lit(means[i])).alias(f"d{i}") for i in size))
        sums = left.agg(*(F.sum(F.col(f"d{i}") * F.col(f"d{j}")) for i in size for j in size if j >= i)).first()
        values = iter([(v or 0.0) / max(found[0], 1) for v in sums])
        square = [[0.0] * len(names) for _ in size]
        for i in size:
            for j in size[i:]:
                square[i][j] = square[j][i] = next(values)
        return cls(found[0], means, square)


def eliminated(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of symmetric equations; 0 for unknowns that follow from earlier ones."""
    rows = [[*row, r] for row, r in zip(matrix, right)]
    for k in range(len(rows)):
        pivot = rows[k][k]
        unit = [v / pivot for v in rows[k]] if pivot > DEPENDENT * matrix[k][k] else [0.0] * len(rows[k])
        rows = [unit if i == k else [a - row[k] * b for a, b in zip(row, unit)] for i, row in enumerate(rows)]
    return [row[-1] for row in rows]


def descended(matrix: list[list[float]], right: list[float], penalty: float, spread: float) -> list[float]:
    """Lasso weights by coordinate descent; ``spread`` is the target's variance."""
    weights = [0.0] * len(right)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, row in enumerate(matrix):
            if row[j] <= 0:
                continue
            pull = right[j] - sum(c * w for k, (c, w) in enumerate(zip(row, weights)) if k != j)
            new = max(abs(pull) - penalty, 0.0) / row[j] * (1 if pull > 0 else -1)
            moved = max(moved, abs(new - weights[j]) * row[j] ** 0.5)
            weights[j] = new
        if moved <= STILL * max(spread, 1e-300) ** 0.5:
            break
    return weights


def violation(matrix: list[list[float]], right: list[float], weights: list[float], penalty: float) -> float:
    """How far lasso weights are from optimal: the largest breach of the subgradient conditions."""
    worst = 0.0
    for j, row in enumerate(matrix):
        pull = right[j] - sum(c * w for c, w in zip(row, weights))
        worst = max(worst, abs(pull) - penalty if weights[j] == 0 else abs(pull - penalty * (1 if weights[j] > 0 else -1)))
    return worst


@dataclass
class LinearFit:
    features: list[str]
    coefficients: list[float]
    intercept: float

    @classmethod
    def of(cls, moments: Moments, features: list[str], *, ridge: float = 0.0, lasso: float = 0.0) -> LinearFit:
        size = len(features)
        square = [row[:size] for row in moments.covariances[:size]]
        right = moments.covariances[size][:size]
        if lasso:
            weights = descended(square, right, lasso, moments.covariances[size][size])
        else:
            for j in range(size):
                square[j][j] += ridge / max(moments.count, 1)
            weights = eliminated(square, right)
        return cls(features, weights, moments.means[size] - sum(w * m for w, m in zip(weights, moments.means)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``prediction``; missing where a feature is."""
        terms = (F.lit(w) * F.col(c).cast("double") for c, w in zip(self.features, self.coefficients))
        return rows.withColumn("prediction", reduce(lambda a, b: a + b, terms, F.lit(self.intercept)))
