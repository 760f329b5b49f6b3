import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.forecasting import arima as ar
from cohortia.forecasting import evaluation as ev
from cohortia.forecasting import smoothing as smo
from cohortia.forecasting.series import clamped, forecast_rows, to_series

VALUES = [10000, 10500, 9800, 10200, 10800, 11200]
YEARS = list(range(2019, 2025))


def frame(spark, *series):
    rows = [(k, 2019 + i, float(v)) for k, values in enumerate(series) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, year int, learner_count double")


@pytest.fixture(scope="module")
def golden(spark):
    return to_series(frame(spark, VALUES), ["k"])


def steps(series, model, k=0, periods=3):
    row = model(series, periods).where(F.col("k") == k).select("steps").first()
    return [tuple(s) for s in row.steps]


def close(found, expected, tolerance=1e-4):
    assert np.allclose(np.array(found, dtype=float), np.array(expected, dtype=float), atol=tolerance), (found, expected)


def test_series_are_sorted_by_year(spark):
    shuffled = spark.createDataFrame([("a", 2021, 3), ("a", 2019, 1), ("a", 2020, 2)], "k string, year int, learner_count bigint")
    row = to_series(shuffled, ["k"]).first()
    assert (row.years, row.y) == ([2019, 2020, 2021], [1.0, 2.0, 3.0])
    assert to_series(shuffled.limit(0), []).count() == 0


def test_naive(golden):
    close(steps(golden, smo.naive), [(11200, 10263.9988, 12136.0012)] * 3)


def test_lstm_proxy(golden):
    close(steps(golden, smo.lstm_proxy), [
        (10818.5898, 10367.0696, 11270.1101), (10993.5898, 10542.0696, 11445.1101),
        (11168.5898, 10717.0696, 11620.1101)])


def test_lstm_saved(golden):
    expected = [10812.835, 11052.835, 11292.835]
    close(steps(golden, smo.lstm_saved), [(v, v * 0.85, v * 1.15) for v in expected])


def test_smoothing_and_holt(golden):
    smoothed = [r.smoothed for r in smo.smoothed_rows(golden, ["k"]).orderBy("year").collect()]
    close(smoothed, [10000, 10150, 10045, 10091.5, 10304.05, 10572.835])
    last = smo.holt_rows(golden, ["k"]).orderBy(F.desc("year")).first()
    close([last.level, last.trend], [11446.0959, 412.2426])


@pytest.mark.parametrize("method, expected", [
    ("holt", [11858.3386, 12270.5812, 12682.8238]), ("ema", [10687.402, 10801.969, 10916.536]),
    ("sma", [10733.3333] * 3)])
def test_value_forecasts(golden, method, expected):
    found = smo.value_forecast(golden, ["k"], method).orderBy("year").collect()
    close([r.forecast_learner_count for r in found], expected)
    assert [r.year for r in found] == [2025, 2026, 2027]


def test_linear_trend(spark):
    found = smo.linear_trend(frame(spark, VALUES, [5]), ["k"]).orderBy("k", "year").collect()
    close([r.predicted_learner_count for r in found[:3]], [11146.6667, 11355.2381, 11563.8095])
    assert found[0].growth_rate == 3.7
    assert [(r.predicted_learner_count, r.growth_rate) for r in found[3:]] == [(5.0, 0.0)] * 3


def css(w, phi, theta):
    e, total = 0.0, 0.0
    for before, now in zip(w, w[1:]):
        e = now - phi * before - theta * e
        total += e * e
    return total, e


@pytest.mark.parametrize("reach", [ar.ARIMA_REACH, ar.SARIMA_REACH])
def test_best_fit_is_not_above_a_fine_grid(spark, reach):
    rng = np.random.default_rng(7)
    series = [VALUES] + [list(np.round(1000 + np.cumsum(rng.normal(0, 50, n)))) for n in (5, 6, 9, 14, 25)]
    fitted = ar.with_fit(to_series(frame(spark, *series), ["k"]), seasonal=reach == ar.SARIMA_REACH)
    for row in fitted.collect():
        w = np.diff(series[row.k])
        grid = np.linspace(-reach, reach, 191)
        best = min(css(w, phi, theta)[0] for phi in grid for theta in grid)
        assert row.fit.order == "111" and row.fit.sse <= best * (1 + 1e-9)
        assert np.isclose(css(w, row.fit.phi, row.fit.theta)[0], row.fit.sse)
        assert abs(row.fit.theta) <= reach
        if reach == ar.ARIMA_REACH:
            assert abs(row.fit.phi) <= reach


def test_theta_is_found_between_the_steps_of_the_grid(spark):
    """A moving average with known residuals: the sum of squares is least at its own theta."""
    rng = np.random.default_rng(3)
    e = rng.normal(0, 1, 400)
    w = e[1:] + 0.437 * e[:-1]
    y = [0.0, *np.cumsum(w).tolist()]
    row = spark.createDataFrame([(y,)], "y array<double>").select(ar.fit_011(ar.differences(F.col("y")), 0.95).alias("f")).first()

    def total(theta):
        s = last = 0.0
        for x in w:
            last = x - theta * last
            s += last * last
        return s

    # Steps of 5e-6 to either side are not better by more than what rounding leaves.
    assert abs(row.f.theta - 0.437) < 0.1 and row.f.sse <= min(total(row.f.theta + d) for d in (-1e-4, 1e-4))


def test_forecast_follows_the_fit(spark, golden):
    row = ar.arima(golden, 4).first()
    f, y = row.fit, np.array(VALUES, dtype=float)
    w, e = np.diff(y), css(np.diff(y), row.fit.phi, row.fit.theta)[1]
    level, change, psi, weight = y[-1], f.phi * w[-1] + f.theta * e, 1.0, 0.0
    sigma = np.sqrt(f.sse / (len(w) - 1))
    for j, s in enumerate(row.steps):
        level, weight = level + change, weight + psi ** 2
        close([s.predicted, s.lower, s.upper], [
            level, level - 1.96 * sigma * np.sqrt(weight), level + 1.96 * sigma * np.sqrt(weight)], 1e-6)
        change, psi = f.phi * change, psi + f.phi ** j * (f.phi + f.theta)


@pytest.mark.parametrize("length, arima, sarima", [
    (1, None, None), (2, "011", "011"), (3, "111", "111"), (4, "111", "111"), (5, "111", "111")])
def test_short_series_fall_back(spark, length, arima, sarima):
    series = to_series(frame(spark, VALUES[:length]), ["k"])
    for seasonal, expected in ((False, arima), (True, sarima)):
        row = ar.arima(series, seasonal=seasonal).first()
        assert (row.fit.order if row.fit else None) == expected
        if expected is None:
            assert steps(series, smo.naive) == [tuple(s) for s in row.steps]


def test_only_finite_fits_are_valid(spark):
    """Squares of such moves overflow: no order gives a value, the naive forecast does."""
    series = to_series(frame(spark, [1e200, -1e200, 1e200, -1e200, 1e200]), ["k"])
    for model in (ar.arima, ar.sarima):
        row = model(series).first()
        assert row.fit is None and [tuple(s) for s in row.steps] == steps(series, smo.naive)
    # One move leaves no residual.
    rows = spark.createDataFrame([([3.0, 5.0, 4.0],)], "y array<double>").select(
        ar.valid(ar.fit_000(F.col("y"))).alias("mean"), ar.valid(ar.fit_111(F.array(F.lit(1.0)), 0.95)).alias("none")).first()
    assert rows["mean"].order == "000" and rows["none"] is None


def test_constant_series(spark):
    constant = to_series(frame(spark, [5.0] * 3, [5.0] * 4, [5.0] * 7), ["k"])
    orders = {r.k: r.fit.order for r in ar.with_fit(constant).collect()}
    assert orders == {0: "111", 1: "111", 2: "111"}
    for k in range(3):
        assert [s[0] for s in steps(constant, ar.arima, k)] == [5.0] * 3
    trained = ar.ssa_training(constant).where("k = 0").first()
    assert [tuple(s) for s in trained.steps] == [(5.0, 4.0, 6.0)] * 3


def test_ssa_training_skips_one_point_and_averages_two(spark):
    series = to_series(frame(spark, [10], [10, 20], VALUES), ["k"])
    found = {r.k: r.steps for r in ar.ssa_training(series).collect()}
    assert set(found) == {1, 2}
    close([tuple(s) for s in found[1]], [(15, 15 - 1.96 * 5, 15 + 1.96 * 5)] * 3)
    x, y = np.array(VALUES[:-1], float), np.array(VALUES[1:], float)
    slope, const = np.polyfit(x, y, 1)
    close(found[2][0].predicted, const + slope * VALUES[-1], 1e-6)


def test_clamps(spark):
    series = to_series(frame(spark, [100, 10, 90, 5, 60, 1], [0, 0]), ["k"])
    for model in (smo.naive, smo.lstm_proxy, ar.arima, ar.sarima):
        rows = model(series, 3).withColumn("steps", clamped(F.col("steps")))
        for r in forecast_rows(rows, ["k"], "M").collect():
            assert 0 <= r.lower_ci <= r.predicted_enrolments <= r.upper_ci
    only = spark.sql("select array(struct(-1D as predicted, -2D as lower, -3D as upper)) as steps")
    assert [tuple(s) for s in only.select(clamped(F.col("steps"))).first()[0]] == [(0.0, 0.0, 0.0)]


def test_metrics_come_from_the_residuals(golden):
    row = ev.training_metrics(golden, ["k"], "arima").first()
    f = ar.with_fit(golden).first().fit
    e, errors = 0.0, []
    w = np.diff(VALUES).astype(float)
    for before, now in zip(w, w[1:]):
        e = now - f.phi * before - f.theta * e
        errors.append(e)
    errors = np.array(errors)
    close([row.mae, row.rmse, row.mape], [
        np.abs(errors).mean(), np.sqrt((errors ** 2).mean()), np.abs(errors / np.array(VALUES[2:])).mean() * 100], 0.006)
    assert (row.model, row.data_points, row.forecast_periods) == ("ARIMA", 6, 3)
    assert ev.training_metrics(golden, ["k"], "lstm").first().mae is None


@pytest.mark.parametrize("length", [2, 3, 4])
def test_metrics_of_short_series(spark, length):
    row = ev.training_metrics(to_series(frame(spark, VALUES[:length]), ["k"]), ["k"], "arima").first()
    assert row.mae is not None and row.mae >= 0


def test_backtest_holds_out_the_end(golden):
    found = {r.model_type: r for r in ev.backtest(golden, ["k"], {"naive": smo.naive, "arima": ar.arima}, 2).collect()}
    errors = np.array([10800 - 10200, 11200 - 10200], float)
    close([found["NAIVE"].mae, found["NAIVE"].rmse], [errors.mean(), np.sqrt((errors ** 2).mean())])
    assert set(found) == {"NAIVE", "ARIMA"}


GROWING = [[100, 105, 112, 121, 133, 149, 170, 198], [100, 110, 130], [900, 450, 225], [50, 60, 70, 80]]


@pytest.mark.parametrize("values", GROWING)
def test_ar1_stays_stationary_with_an_interval(spark, values):
    rows = spark.createDataFrame([([float(v) for v in values],)], "y array<double>")
    fit = rows.select(ar.fit_100(F.col("y")).alias("fit")).first()["fit"]
    assert abs(fit["phi"]) <= 0.95
    steps = rows.withColumn("fit", ar.fit_100(F.col("y"))).select(ar.fit_steps(
        F.col("fit"), F.col("y"), ar.differences(F.col("y")), 3).alias("s")).first()["s"]
    assert all(s["upper"] - s["lower"] > 1 for s in steps)
    assert all(s["predicted"] < 2 * max(values) for s in steps)
