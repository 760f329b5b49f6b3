"""Order search: all feasible (p, d, q) of every series, compared by Gaussian likelihoods of the same points.

A row per series and order goes through array expressions, with no Python and no collected state:

1. The series is differenced d times; without differences its mean is taken off and counts as a parameter.
2. Hannan and Rissanen's two regressions: a long autoregression by the Levinson-Durbin recursion gives
   residuals, then the series is regressed on its own and the residuals' lags. The normal equations are
   solved by elimination over nested arrays.
3. The recursion run backwards gives the partial autocorrelations, which tell whether the fit is stationary and
   invertible; forwards they give the exact autocovariances of the fitted process.
4. On these the recursion yields one-step errors and their variances. The errors from the third point
   of the series on are those of the series itself, whatever d is, so that the likelihoods of all
   orders speak of the same points.

An order is feasible if the second regression has more rows than unknowns, is not singular and
ends in a stationary and invertible process; the others have no likelihood and no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.forecasting.series import let, mean, total

MAX_P, MAX_D, MAX_Q = 3, 2, 3
FIRST_SCORED = 3           # points before it start the differences
SINGULAR = 1e-8            # share of a regressor's square that its predecessors must leave
EDGE = 1e-9                # distance of a partial autocorrelation from 1
TINY_SSE = 1e-9


def upto(k: Column) -> Column:
    """1 to k; nothing for 0."""
    return F.filter(F.sequence(F.lit(0), k.cast("int")), lambda i: i > 0)


def lagged(weights: Column, values: Column, t: Column) -> Column:
    """Weights times the values before place t (from 1), the nearest first."""
    count = F.size(weights)
    return total(F.zip_with(weights, F.reverse(F.slice(values, t - count, count)), lambda a, b: a * b))


def differenced(y: Column) -> Column:
    count = F.greatest(F.size(y) - 1, F.lit(0))
    return F.zip_with(F.slice(y, 2, count), F.slice(y, 1, count), lambda now, before: now - before)


def autocovariances(x: Column, most: Column) -> Column:
    """At lags 0 to most, over the length of the series."""
    n = F.size(x)
    return F.transform(F.concat(F.array(F.lit(0)), upto(most)), lambda h: total(F.zip_with(
        F.slice(x, h + 1, n - h), F.slice(x, 1, n - h), lambda a, b: a * b)) / n)


def _raised(weights: Column, reflection: Column) -> Column:
    """The weights of the next order."""
    return F.concat(F.zip_with(weights, F.reverse(weights), lambda a, b: a - reflection * b), F.array(reflection))


_NONE = "array<double>"


def autoregression(g: Column, order: Column) -> Column:
    """Weights of the best predictor from ``order`` values, from autocovariances g."""
    def move(s: Column, k: Column) -> Column:
        return let(F.try_divide(F.get(g, k) - lagged(s["a"], g, k + 1), s["v"]), lambda r: F.struct(
            _raised(s["a"], r).alias("a"), (s["v"] * (1 - r * r)).alias("v")))

    start = F.struct(F.array().cast(_NONE).alias("a"), F.get(g, F.lit(0)).alias("v"))
    return F.aggregate(upto(order), start, move, lambda s: s["a"])


def residuals(x: Column, weights: Column) -> Column:
    """One-step errors; 0 before the first that has all lags."""
    return F.transform(upto(F.size(x)), lambda t: F.when(t <= F.size(weights), 0.0).otherwise(
        F.get(x, t - 1) - lagged(weights, x, t)))


def solved(rows: Column, unknowns: Column) -> Column:
    """Least squares of rows [regressors..., target] by elimination; NULL if singular."""
    def matrix() -> Column:
        return F.transform(upto(unknowns), lambda i: F.transform(upto(unknowns + 1), lambda j: total(
            F.transform(rows, lambda r: F.get(r, i - 1) * F.get(r, j - 1)))))

    def eliminate(s: Column, k: Column) -> Column:
        top = F.get(s["m"], k - 1)
        fits = F.get(top, k - 1) > SINGULAR * F.get(s["diagonal"], k - 1)
        return let(F.transform(top, lambda v: F.try_divide(v, F.get(top, k - 1))), lambda unit: F.struct(
            F.when(s["fits"] & fits, F.transform(s["m"], lambda row, i: F.when(i == k - 1, unit).otherwise(
                F.zip_with(row, unit, lambda a, b: a - F.get(row, k - 1) * b)))).otherwise(s["m"]).alias("m"),
            s["diagonal"].alias("diagonal"), (s["fits"] & fits).alias("fits")))

    return let(matrix(), lambda m: F.aggregate(upto(unknowns), F.struct(
        m.alias("m"), F.transform(m, lambda row, i: F.get(row, i)).alias("diagonal"), F.lit(True).alias("fits")), eliminate,
        lambda s: F.when(s["fits"], F.transform(s["m"], lambda row: F.get(row, unknowns)))))


def lower_orders(weights: Column) -> Column:
    """The weights of every order up to the given one, lowest first; NULL unless all reflections are below 1."""
    def lower(s: Column, _k: Column) -> Column:
        a, m = s["a"], F.size(s["a"])
        r = F.element_at(a, -1)
        rest = F.slice(a, 1, m - 1)
        return F.struct(
            F.zip_with(rest, F.reverse(rest), lambda x, y: F.try_divide(x + r * y, 1 - r * r)).alias("a"),
            F.concat(F.array(a), s["all"]).alias("all"), (s["inside"] & (F.abs(r) < 1 - EDGE)).alias("inside"))

    start = F.struct(weights.alias("a"), F.array().cast("array<array<double>>").alias("all"), F.lit(True).alias("inside"))
    return F.aggregate(weights, start, lower, lambda s: F.when(s["inside"], s["all"]))


def process_autocovariances(phi: Column, levels: Column, theta: Column, most: Column) -> Column:
    """Exact autocovariances at lags 0 to most for errors of variance 1, from all lower orders of phi."""
    kept = F.aggregate(levels, F.lit(1.0), lambda v, a: v * (1 - F.element_at(a, -1) * F.element_at(a, -1)))

    def further(g: Column, h: Column) -> Column:
        weights = F.coalesce(F.get(levels, h - 1), phi)
        return F.concat(g, F.array(lagged(weights, g, h + 1)))

    own = F.aggregate(upto(most + F.size(theta)), F.array(F.try_divide(F.lit(1.0), kept)), further)
    moving = F.concat(F.array(F.lit(1.0)), theta)
    return let(own, lambda g: F.transform(F.concat(F.array(F.lit(0)), upto(most)), lambda h: total(F.flatten(
        F.transform(moving, lambda a, i: F.transform(moving, lambda b, j: a * b * F.get(g, F.abs(h - i + j))))))))


def innovations(x: Column, g: Column) -> Column:
    """One-step errors and their variances under autocovariances g."""
    def move(s: Column, t: Column) -> Column:
        error = F.get(x, t - 1) - lagged(s["a"], x, t)
        return let(F.try_divide(F.get(g, t) - lagged(s["a"], g, t + 1), s["v"]), lambda r: F.struct(
            _raised(s["a"], r).alias("a"), (s["v"] * (1 - r * r)).alias("v"),
            F.concat(s["out"], F.array(F.struct(error.alias("e"), s["v"].alias("v")))).alias("out")))

    start = F.struct(F.array().cast(_NONE).alias("a"), F.get(g, F.lit(0)).alias("v"),
                     F.array().cast("array<struct<e:double,v:double>>").alias("out"))
    return F.aggregate(upto(F.size(x)), start, move, lambda s: s["out"])


def order_candidates(series: DataFrame, keys: list[str], *, max_p: int = MAX_P, max_d: int = MAX_D,
                     max_q: int = MAX_Q) -> DataFrame:
    """A row per key and feasible order: parameters, innovations variance, AIC, BIC and log-likelihood."""
    every = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"))
                      for p in range(max_p + 1) for d in range(max_d + 1) for q in range(max_q + 1)])
    n = F.size("y")

    def long(o: Column) -> Column:
        return F.when(o["q"] > 0, F.greatest(o["p"], o["q"])).otherwise(0)

    def skipped(o: Column) -> Column:
        return F.when(o["q"] > 0, long(o) + o["q"]).otherwise(o["p"])

    possible = F.filter(every, lambda o: (n >= FIRST_SCORED) & (n - o["d"] - skipped(o) > o["p"] + o["q"]))
    # Keys travel in one column, whatever their names.
    rows = series.select(F.struct(F.lit(0).alias("0"), *keys).alias("key"), "y", F.explode(possible).alias("o"))
    p, d, q = F.col("o.p"), F.col("o.d"), F.col("o.q")
    y = F.col("y")
    const = F.when(d == 0, mean(y)).otherwise(0.0)
    x = F.when(d == 0, let(mean(y), lambda m: F.transform(y, lambda v: v - m))).when(d == 1, differenced(y)).otherwise(
        differenced(differenced(y)))

    def design(x: Column, e: Column) -> Column:
        return F.transform(F.filter(upto(F.size(x)), lambda t: t > skipped(F.col("o"))), lambda t: F.concat(
            F.reverse(F.slice(x, t - p, p)), F.reverse(F.slice(e, t - q, q)), F.array(F.get(x, t - 1))))

    def fitted(x: Column) -> Column:
        ahead = let(autocovariances(x, long(F.col("o"))), lambda g: autoregression(g, long(F.col("o"))))
        return let(let(ahead, lambda a: residuals(x, a)), lambda e: let(design(x, e), lambda z: solved(z, p + q)))

    # Each step is worked out once: its frame is one projection, and let() keeps what is used twice.
    rows = rows.select("key", "o", n.alias("n"), const.alias("const"), let(x, lambda x: F.struct(
        x.alias("x"), fitted(x).alias("fit"))).alias("s"))
    scored = let(F.col("s"), lambda s: let(F.struct(F.slice(s["fit"], 1, p).alias("phi"), F.slice(s["fit"], p + 1, q).alias("theta")), lambda c: let(
        F.struct(lower_orders(c["phi"]).alias("levels"), lower_orders(F.transform(c["theta"], lambda v: -v)).alias("mirror")),
        lambda low: F.when(low["levels"].isNotNull() & low["mirror"].isNotNull(), let(
            process_autocovariances(c["phi"], low["levels"], c["theta"], F.size(s["x"])), lambda g: let(
                F.slice(innovations(s["x"], g), FIRST_SCORED - d, F.col("n") - (FIRST_SCORED - 1)), lambda out: F.struct(
                    c["phi"].alias("phi"), c["theta"].alias("theta"),
                    total(F.transform(out, lambda u: u["e"] * u["e"] / u["v"])).alias("sse"),
                    total(F.transform(out, lambda u: F.ln(u["v"]))).alias("logs"))))))))
    found = rows.select("key", "o", "n", "const", F.explode(F.filter(F.array(scored), lambda r: r.isNotNull())).alias("r"))
    count = (F.col("n") - (FIRST_SCORED - 1)).cast("double")
    k = p + q + 1 + F.when(d == 0, 1).otherwise(0)
    found = found.select(
        "key", F.concat(p.cast("string"), d.cast("string"), q.cast("string")).alias("order"),
        *(F.get("r.phi", F.lit(i)).alias(f"phi_{i + 1}") for i in range(max_p)),
        *(F.get("r.theta", F.lit(i)).alias(f"theta_{i + 1}") for i in range(max_q)), "const",
        (F.greatest("r.sse", F.lit(TINY_SSE)) / count).alias("variance"), F.col("r.logs").alias("logs"), count.alias("count"), k.alias("k"))
    likelihood = -F.col("count") / 2 * (F.ln(2 * F.pi() * F.col("variance")) + 1) - F.col("logs") / 2
    found = found.withColumn("log_likelihood", likelihood)
    return found.select(
        *(F.col("key")[c].alias(c) for c in keys),
        *(c for c in found.columns if c not in ("key", "logs", "count", "k", "log_likelihood")),
        (-2 * F.col("log_likelihood") + 2 * F.col("k")).alias("aic"),
        (-2 * F.col("log_likelihood") + F.col("k") * F.ln("count")).alias("bic"), "log_likelihood")


def best_orders(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the lowest AIC per key; the shorter order wins a tie."""
    own = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(
        F.min_by(F.struct(*own), F.struct(F.round("aic", 6), F.col("order"))).alias("best")).select(*keys, "best.*")
