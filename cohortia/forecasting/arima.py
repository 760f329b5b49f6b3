"""ARIMA-type forecasts for all series at once, as array expressions.

Parameters minimise the conditional sum of squares. With residuals
``e_t = w_t - phi w_{t-1} - theta e_{t-1}`` and a fixed theta, ``e`` is linear
in phi: ``e = a - phi b`` where both parts follow the same recursion. So phi
and the sum of squares have a closed form, and only theta is searched: a coarse
grid over its whole range, then ever narrower steps around the best so far.

Every order of the fallback chain is tried on every series. A fit is valid if it has
at least one residual and a finite sum of squares; the first valid one is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.forecasting.series import FORECAST_PERIODS, let, mean, step
from cohortia.forecasting.smoothing import horizon, last, naive_steps

Z95 = 1.96
ARIMA_REACH = 0.95   # of phi and theta: stationary and invertible
SARIMA_REACH = 1.0   # of theta: beyond 1 its inverse gives the same process; phi is free
COARSE = 10          # grid steps on either side of 0
# Steps and the places tried around the best so far: the grid, then steps of a third of those before.
ROUNDS = [(1.0, list(range(-COARSE, COARSE + 1))), *((3.0 ** -k, [-2, -1, 1, 2]) for k in range(1, 11))]
TINY_SSE = 1e-9


def differences(y: Column) -> Column:
    later = F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0)))
    earlier = F.slice(y, 1, F.greatest(F.size(y) - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda a, b: a - b)


def successive(values: Column) -> Column:
    """Pairs (now, before) of neighbouring values."""
    count = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(
        F.slice(values, 2, count), F.slice(values, 1, count),
        lambda now, before: F.struct(now.alias("now"), before.alias("before")))


def fit(order: str, sse: Column, count: Column, phi: Column, theta: Column, const: Column,
        e_last: Column) -> Column:
    """A fit; the sum of squares comes first, so that the smallest fit is the best."""
    return F.struct(
        sse.cast("double").alias("sse"), phi.cast("double").alias("phi"),
        theta.cast("double").alias("theta"), const.cast("double").alias("const"),
        e_last.cast("double").alias("e_last"), count.cast("int").alias("count"),
        F.lit(order).alias("order"))


def within(value: Column, reach: float) -> Column:
    return F.greatest(F.least(value, F.lit(reach)), F.lit(-reach))


def best_theta(profile: Callable[[Column], Column], reach: float) -> Column:
    """The smallest profile (a struct with theta) over -reach..reach, down to steps of 3^-10 of the grid's."""
    grid = F.lit(reach / COARSE)
    rounds = F.array(*(F.struct(F.lit(share).alias("share"), F.array(*map(F.lit, places)).alias("places"))
                       for share, places in ROUNDS))

    def narrower(best: Column, tried: Column) -> Column:
        return F.least(best, F.array_min(F.transform(tried["places"], lambda i: profile(
            within(best["theta"] + i * (grid * tried["share"]), reach)))))

    return F.aggregate(rounds, profiled(F.lit(float("inf")), F.lit(0.0), F.lit(0.0)), narrower)


def profiled(sse: Column, theta: Column, phi: Column) -> Column:
    """Compared in this order, so that ties go to the theta nearest to 0."""
    return F.struct(F.greatest(sse, F.lit(0.0)).alias("sse"), F.abs(theta).alias("size"), theta.alias("theta"), phi.alias("phi"))


def valid(found: Column) -> Column:
    return F.when((found["count"] > 0) & (F.abs(found["sse"]) < float("inf")), found)


def fit_111(w: Column, reach: float, bounded: bool = True) -> Column:
    """Best (phi, theta) on the first differences, from the second difference on; ``bounded`` holds for phi."""
    def start(*names: str) -> Column:
        return F.struct(*[F.lit(0.0).alias(name) for name in names])

    def profile(pairs: Column, theta: Column) -> Column:
        def parts(s: Column, p: Column) -> Column:
            a, b = p["now"] - theta * s["a"], p["before"] - theta * s["b"]
            return F.struct(a.alias("a"), b.alias("b"), (s["aa"] + a * a).alias("aa"),
                            (s["ab"] + a * b).alias("ab"), (s["bb"] + b * b).alias("bb"))

        def closed(s: Column) -> Column:
            slope = F.try_divide(s["ab"], s["bb"])
            phi = F.when(s["bb"] == 0, 0.0).otherwise(within(slope, reach) if bounded else slope)
            return let(phi, lambda phi: profiled(s["aa"] - phi * (2 * s["ab"] - phi * s["bb"]), theta, phi))

        return let(F.aggregate(pairs, start("a", "b", "aa", "ab", "bb"), parts), closed)

    def scored(pairs: Column, best: Column) -> Column:
        def residual(s: Column, p: Column) -> Column:
            e = p["now"] - best["phi"] * p["before"] - best["theta"] * s["e"]
            return F.struct(e.alias("e"), (s["sse"] + e * e).alias("sse"))

        return let(F.aggregate(pairs, start("e", "sse"), residual), lambda s: fit(
            "111", s["sse"], F.size(pairs), best["phi"], best["theta"], F.lit(0.0), s["e"]))

    return let(successive(w), lambda pairs: let(
        best_theta(lambda theta: profile(pairs, theta), reach), lambda best: scored(pairs, best)))


def fit_011(w: Column, reach: float) -> Column:
    """Best theta alone, over all differences."""
    def residuals(values: Column, theta: Column) -> Column:
        def residual(s: Column, x: Column) -> Column:
            e = x - theta * s["e"]
            return F.struct(e.alias("e"), (s["sse"] + e * e).alias("sse"))

        return F.aggregate(values, F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("sse")), residual)

    def scored(values: Column, best: Column) -> Column:
        return let(residuals(values, best["theta"]), lambda s: fit(
            "011", s["sse"], F.size(values), F.lit(0.0), best["theta"], F.lit(0.0), s["e"]))

    return let(w, lambda values: let(best_theta(
        lambda theta: let(residuals(values, theta), lambda s: profiled(s["sse"], theta, F.lit(0.0))), reach),
        lambda best: scored(values, best)))


def least_squares(pairs: Column) -> Column:
    """Slope and intercept of now on before; NULL slope for a constant series."""
    def around(means: Column) -> Column:
        sxx = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["before"] - means["x"]) * (p["before"] - means["x"]))
        sxy = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["before"] - means["x"]) * (p["now"] - means["y"]))
        return let(F.try_divide(sxy, sxx), lambda slope: F.struct(
            slope.alias("slope"), (means["y"] - slope * means["x"]).alias("intercept"), means["x"].alias("x")))

    means = F.struct(mean(F.transform(pairs, lambda p: p["before"])).alias("x"),
                     mean(F.transform(pairs, lambda p: p["now"])).alias("y"))
    return let(means, around)


def fit_100(y: Column, with_constant: bool = True, skip: int = 0) -> Column:
    """AR(1) by least squares; NULL where the series is constant.

    With a constant the slope is kept inside the stationary range and the
    constant belongs to the slope so bounded.
    """
    def scored(pairs: Column, phi: Column, const: Column) -> Column:
        kept = F.slice(pairs, 1 + skip, F.greatest(F.size(pairs) - skip, F.lit(0))) if skip else pairs
        sse = F.aggregate(kept, F.lit(0.0), lambda s, p: s + (p["now"] - const - phi * p["before"])
                          * (p["now"] - const - phi * p["before"]))
        return F.when(phi.isNotNull(), fit("100", sse, F.size(kept), phi, F.lit(0.0), const, F.lit(0.0)))

    def with_line(pairs: Column) -> Column:
        if with_constant:
            return let(least_squares(pairs), lambda line: let(
                F.when(line["slope"].isNotNull(), within(line["slope"], ARIMA_REACH)), lambda phi: scored(
                    pairs, phi, line["intercept"] + (line["slope"] - phi) * line["x"])))
        products = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["now"] * p["before"])
        squares = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["before"] * p["before"])
        return let(F.try_divide(products, squares), lambda phi: scored(pairs, phi, F.lit(0.0)))

    return let(successive(y), with_line)


def fit_000(y: Column, skip: int = 0) -> Column:
    kept = F.slice(y, 1 + skip, F.greatest(F.size(y) - skip, F.lit(0))) if skip else y
    return let(mean(y), lambda m: fit(
        "000", F.aggregate(kept, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(kept),
        F.lit(0.0), F.lit(0.0), m, F.lit(0.0)))


# -- from a fit to future values ----------------------------------------------

def integrated_steps(f: Column, y_last: Column, w_last: Column, periods: int) -> Column:
    """Orders (p,1,q): the differences die out, their errors add up."""
    def move(s: Column, _h: Column) -> Column:
        level, weight = s["level"] + s["w"], s["weight"] + s["psi"] * s["psi"]
        return F.struct(
            (f["phi"] * s["w"]).alias("w"), level.alias("level"), (f["phi"] * s["c"]).alias("c"),
            (s["psi"] + s["c"]).alias("psi"), weight.alias("weight"),
            F.concat(s["out"], F.array(F.struct(level.alias("level"), F.sqrt(weight).alias("spread")))).alias("out"))

    empty = F.array().cast("array<struct<level:double,spread:double>>")
    start = F.struct(
        (f["phi"] * w_last + f["theta"] * f["e_last"]).alias("w"), y_last.alias("level"),
        (f["phi"] + f["theta"]).alias("c"), F.lit(1.0).alias("psi"), F.lit(0.0).alias("weight"),
        empty.alias("out"))
    return F.aggregate(horizon(periods), start, move, lambda s: s["out"])


def stationary_steps(f: Column, y_last: Column, periods: int) -> Column:
    """Orders (p,0,0): the level goes back to the mean, its errors fade."""
    def move(s: Column, _h: Column) -> Column:
        level, weight = f["const"] + f["phi"] * s["level"], s["weight"] + s["psi"] * s["psi"]
        return F.struct(
            level.alias("level"), (f["phi"] * s["psi"]).alias("psi"), weight.alias("weight"),
            F.concat(s["out"], F.array(F.struct(level.alias("level"), F.sqrt(weight).alias("spread")))).alias("out"))

    empty = F.array().cast("array<struct<level:double,spread:double>>")
    start = F.struct(y_last.alias("level"), F.lit(1.0).alias("psi"), F.lit(0.0).alias("weight"), empty.alias("out"))
    return F.aggregate(horizon(periods), start, move, lambda s: s["out"])


def with_interval(points: Column, sigma: Column) -> Column:
    return F.transform(points, lambda p: let(
        p["spread"] * sigma * Z95, lambda margin: step(p["level"], p["level"] - margin, p["level"] + margin)))


def fit_steps(f: Column, y: Column, w: Column, periods: int) -> Column:
    # An exact fit of a few points says nothing of the spread; the moves of the series do.
    moved = F.sqrt(mean(F.transform(w, lambda x: x * x)))
    sigma = F.when(f["sse"] <= TINY_SSE, moved).otherwise(F.sqrt(F.try_divide(f["sse"], f["count"])))
    future = F.when(F.substring(f["order"], 2, 1) == "1", integrated_steps(f, last(y), last(w), periods)).otherwise(
        stationary_steps(f, last(y), periods))
    return let(sigma, lambda s: with_interval(future, s))


def with_fit(series: DataFrame, seasonal: bool = False) -> DataFrame:
    """Adds the first valid fit of the fallback chain; NULL for series of less than two points."""
    y, n = F.col("y"), F.size("y")
    w = differences(y)
    reach = SARIMA_REACH if seasonal else ARIMA_REACH
    chain = [fit_111(w, reach, bounded=not seasonal), fit_011(w, reach), fit_100(y, with_constant=not seasonal)]
    if not seasonal:
        chain.append(fit_000(y))
    return series.withColumn("fit", F.when(n >= 2, F.coalesce(*(let(found, valid) for found in chain))))


def arima(series: DataFrame, periods: int = FORECAST_PERIODS, seasonal: bool = False) -> DataFrame:
    """(1,1,1), (0,1,1), (1,0,0), (0,0,0), naive: the first that fits."""
    y = F.col("y")
    steps = F.coalesce(
        F.when(F.col("fit").isNotNull(), fit_steps(F.col("fit"), y, differences(y), periods)),
        naive_steps(y, periods))
    return with_fit(series, seasonal).withColumn("steps", steps)


def sarima(series: DataFrame, periods: int = FORECAST_PERIODS) -> DataFrame:
    """Yearly data has no season: as ARIMA on a wider grid, without (0,0,0)."""
    return arima(series, periods, seasonal=True)


# -- training per subject area -------------------------------------------------

MEAN_LOW, MEAN_HIGH = 0.8, 1.2


def ssa_training(series: DataFrame, periods: int = FORECAST_PERIODS) -> DataFrame:
    """AR(1) with a mean from three points on, the mean for two, nothing below.

    A constant series falls back to its mean with a margin in percent.
    Predictions and lower bounds are not negative; upper bounds stay as they are.
    """
    y, n = F.col("y"), F.size("y")
    zero = F.lit(0.0)
    chosen = F.when(n >= 3, fit_100(y)).otherwise(fit_000(y))
    fitted = series.where(n >= 2).withColumn("fit", chosen)
    from_fit = F.transform(
        fit_steps(F.col("fit"), y, differences(y), periods),
        lambda s: step(F.greatest(s["predicted"], zero), F.greatest(s["lower"], zero), s["upper"]))
    from_mean = F.array_repeat(let(mean(y), lambda m: step(m, m * MEAN_LOW, m * MEAN_HIGH)), periods)
    return fitted.withColumn("steps", F.when(F.col("fit").isNotNull(), from_fit).otherwise(from_mean))
