"""The order search against plain numpy: two regressions, and likelihoods of multivariate normal distributions."""

import itertools

import numpy as np
import pytest

from cohortia.forecasting import orders as od
from cohortia.forecasting.series import to_series


def impulse(phi, theta, most=4000):
    out = [1.0]
    for j in range(1, most):
        out.append((theta[j - 1] if j <= len(theta) else 0.0) + sum(f * out[j - i - 1] for i, f in enumerate(phi) if j - i - 1 >= 0))
    return np.array(out)


def largest_root(weights):
    return max(np.abs(np.linalg.eigvals(np.vstack([weights, np.eye(len(weights))[:-1]]))), default=0.0) if len(weights) else 0.0


def plain(y, p, d, q):
    """phi, theta and log-likelihood of the points from the third on, or None."""
    x = np.diff(y, d) if d else y - np.mean(y)
    n, m = len(x), max(p, q) if q else 0
    start = m + q if q else p
    if n - start <= p + q:
        return None
    e = np.zeros(n)
    if m:
        g = [x[h:] @ x[:n - h] / n for h in range(m + 1)]
        a = np.linalg.solve([[g[abs(i - j)] for j in range(m)] for i in range(m)], g[1:])
        for t in range(m, n):
            e[t] = x[t] - a @ x[t - m:t][::-1]
    z = np.array([[*x[t - p:t][::-1], *e[t - q:t][::-1]] for t in range(start, n)]).reshape(n - start, p + q)
    fit = np.linalg.lstsq(z, x[start:], rcond=None)[0] if p + q else np.zeros(0)
    phi, theta = fit[:p], fit[p:]
    if max(largest_root(phi), largest_root(-theta)) >= 0.999:
        return None
    psi = impulse(phi, theta)
    g = np.array([psi[h:] @ psi[:len(psi) - h] for h in range(n + 1)])
    cov = np.array([[g[abs(i - j)] for j in range(n)] for i in range(n)])
    skip = 2 - d
    low = np.linalg.cholesky(cov)
    u = np.linalg.solve(low, x)[skip:]
    c = n - skip
    variance = max(u @ u, 1e-9) / c
    return phi, theta, -c / 2 * (np.log(2 * np.pi * variance) + 1) - np.log(np.diag(low)[skip:]).sum()


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(3)
    out = [[10000, 10500, 9800, 10200, 10800, 11200], [5, 9, 7], [5, 9, 7, 12], [3, 8]]
    for n in (5, 8, 12, 30):
        out.append(np.round(100 + np.cumsum(rng.normal(size=n)) * 5, 1).tolist())
        out.append(np.round(50 + rng.normal(size=n) * 9, 1).tolist())
    return out


def test_orders_and_likelihoods(spark, curves):
    rows = [(k, 2000 + t, float(v)) for k, y in enumerate(curves) for t, v in enumerate(y)]
    series = to_series(spark.createDataFrame(rows, "k int, year int, learner_count double"), ["k"])
    found = {(r.k, r.order): r for r in od.order_candidates(series, ["k"]).collect()}
    seen = 0
    for (k, y), p, d, q in itertools.product(enumerate(curves), range(4), range(3), range(4)):
        row = found.get((k, f"{p}{d}{q}"))
        wanted = plain(np.array(y, float), p, d, q) if len(y) >= 3 else None
        if row is None:
            assert wanted is None or max(largest_root(wanted[0]), largest_root(-wanted[1])) > 0.99
        elif wanted is not None:
            seen += 1
            phi, theta, likelihood = wanted
            assert np.allclose([row[f"phi_{i + 1}"] for i in range(p)], phi, atol=1e-6)
            assert np.allclose([row[f"theta_{i + 1}"] for i in range(q)], theta, atol=1e-6)
            assert abs(row.log_likelihood - likelihood) < 1e-4 * max(1, abs(likelihood))
            params = p + q + 1 + (d == 0)
            assert abs(row.aic - 2 * params + 2 * row.log_likelihood) < 1e-9
            assert abs(row.bic - params * np.log(len(y) - 2) + 2 * row.log_likelihood) < 1e-9
    assert seen > 150
    assert any(o[0] == "3" for _, o in found) and any(o[2] == "3" for _, o in found)
    assert not [k for k, _ in found if k == 3]  # two points have no order


def test_best_order_is_the_lowest_aic(spark, curves):
    rows = [(0, 2000 + t, float(v)) for t, v in enumerate(curves[-1])]
    series = to_series(spark.createDataFrame(rows, "k int, year int, learner_count double"), ["k"])
    candidates = od.order_candidates(series, ["k"])
    assert od.best_orders(candidates, ["k"]).first().aic == min(r.aic for r in candidates.collect())


def test_constant_and_empty_series(spark):
    rows = [(0, 2000 + t, 7.0) for t in range(6)]
    series = to_series(spark.createDataFrame(rows, "k int, year int, learner_count double"), ["k"])
    assert {r.order for r in od.order_candidates(series, ["k"]).collect()} == {"000", "010", "020"}
    assert od.order_candidates(series.limit(0), ["k"]).collect() == []
