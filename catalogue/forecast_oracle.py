"""SQL of the forecast, preparation and storage queries.

The forecasts are written as recursive queries over (key, step) rows, which is
independent of the array expressions they check.
"""

from __future__ import annotations

from catalogue.oracle import (
    FIRST_YEAR, LAST_YEAR, SLICE_FUNDING, SLICE_PROVIDER, TOWN, label, star,
)

PERIODS = 3
SHORT_FIRST, SHORT_LAST = 2016, 2018      # three years of history
MIDDLE_FIRST, MIDDLE_LAST = 2015, 2018    # four years of history
HOLD_OUT = 2


def series(name: str, source: str) -> str:
    """Numbered points of every key of ``source(k, year, v)``."""
    return f"""
{name} AS (
  SELECT k, year, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY k ORDER BY year) AS t,
         count(*) OVER (PARTITION BY k) AS n, max(year) OVER (PARTITION BY k) AS last_year
  FROM ({source}))"""


PROVIDER_SERIES = series("s", "SELECT provider_skey AS k, year, learner_count AS v FROM by_provider")


def one_series(where: str) -> str:
    return series("s", f"""SELECT 0 AS k, year, count(DISTINCT learner_skey) AS v
                           FROM enrolled WHERE {where} GROUP BY year""")


def ssa_series(where: str) -> str:
    return series("s", f"""SELECT coalesce(ssa_tier_1_description, 'Unknown') AS k, year,
                           count(DISTINCT learner_skey) AS v FROM enrolled WHERE {where} GROUP BY ALL""")


# -- models: each adds <p>_steps(k, h, predicted, lower, upper) ---------------

def naive_ctes(p: str, s: str = "s", periods: int = PERIODS) -> str:
    return f"""
{p}_level AS (
  SELECT k, max(n) AS n, max(CASE WHEN t = n THEN v END) AS level, sqrt(sum((v - m) * (v - m)) / max(n)) AS spread
  FROM (SELECT *, avg(v) OVER (PARTITION BY k) AS m FROM {s}) GROUP BY k),
{p}_margin AS (
  SELECT k, level, 1.96 * CASE WHEN n = 1 OR spread = 0 THEN greatest(abs(level) * 0.1, 1.0) ELSE spread END AS margin
  FROM {p}_level),
{p}_steps AS (
  SELECT k, h, level AS predicted, level - margin AS lower, level + margin AS upper
  FROM {p}_margin, range(1, {periods + 1}) AS r(h))"""


def smooth_cte(name: str, alpha: float, s: str = "s") -> str:
    return f"""
{name} AS (
  SELECT k, t, n, v, v AS smoothed FROM {s} WHERE t = 1
  UNION ALL
  SELECT {s}.k, {s}.t, {s}.n, {s}.v, CAST({alpha} AS DOUBLE) * {s}.v + CAST({1 - alpha} AS DOUBLE) * {name}.smoothed
  FROM {name} JOIN {s} ON {s}.k = {name}.k AND {s}.t = {name}.t + 1)"""


def lstm_ctes(p: str, s: str = "s", periods: int = PERIODS) -> str:
    return f"""{smooth_cte(p + '_smooth', 0.35, s)},
{p}_level AS (
  SELECT k, n, max(CASE WHEN t = n THEN smoothed END) AS level,
         CASE WHEN n > 1 THEN (max(CASE WHEN t = n THEN v END) - max(CASE WHEN t = n - least(4, n - 1) THEN v END))
                              / least(4, n - 1) ELSE 0 END AS trend,
         sqrt(sum((v - smoothed - m) * (v - smoothed - m)) / n) AS spread
  FROM (SELECT *, avg(v - smoothed) OVER (PARTITION BY k) AS m FROM {p}_smooth) GROUP BY k, n),
{p}_steps AS (
  SELECT k, h, level + trend * h AS predicted, level + trend * h - margin AS lower, level + trend * h + margin AS upper
  FROM (SELECT *, 1.64 * CASE WHEN n = 1 OR spread = 0 THEN greatest(abs(level) * 0.1, 1.0) ELSE spread END AS margin
        FROM {p}_level), range(1, {periods + 1}) AS r(h))"""


def saved_ctes(p: str, s: str = "s") -> str:
    return f"""{smooth_cte(p + '_smooth', 0.3, s)},
{p}_steps AS (
  SELECT k, h, level + trend * h AS predicted, (level + trend * h) * 0.85 AS lower, (level + trend * h) * 1.15 AS upper
  FROM (SELECT k, max(CASE WHEN t = n THEN smoothed END) AS level,
               CASE WHEN n > 1 THEN (max(CASE WHEN t = n THEN v END) - max(CASE WHEN t = 1 THEN v END)) / (n - 1) ELSE 0 END AS trend
        FROM {p}_smooth GROUP BY k, n), range(1, {PERIODS + 1}) AS r(h))"""


def search_ctes(p: str, s: str, reach: float, bounded: bool) -> str:
    """Best (1,1,1) fit per key: a grid of thetas, then ten rounds of four thetas around the best so far."""
    slope = f"greatest(least(ab / bb, CAST({reach} AS DOUBLE)), CAST(-{reach} AS DOUBLE))" if bounded else "ab / bb"
    parts = [f"""
{p}_w AS (SELECT k, n, t, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS w FROM {s}),
{p}_pairs AS (
  SELECT k, n, t - 2 AS j, w AS now, lag(w) OVER (PARTITION BY k ORDER BY t) AS before FROM {p}_w WHERE t >= 2),
{p}_tried0 AS (
  SELECT k, n, greatest(least(i * CAST('{reach / 10!r}' AS DOUBLE), CAST({reach} AS DOUBLE)), CAST(-{reach} AS DOUBLE)) AS theta
  FROM (SELECT DISTINCT k, n FROM {s} WHERE n >= 3), range(-10, 11) AS r(i))"""]
    for level in range(11):
        if level:
            parts.append(f"""
{p}_tried{level} AS (
  SELECT k, n, greatest(least(theta + i * (CAST('{reach / 10!r}' AS DOUBLE) * CAST('{3.0 ** -level!r}' AS DOUBLE)),
    CAST({reach} AS DOUBLE)), CAST(-{reach} AS DOUBLE)) AS theta
  FROM {p}_best{level - 1}, (VALUES (-2), (-1), (1), (2)) AS r(i))""")
        before = f" UNION ALL SELECT k, n, theta, phi, sse FROM {p}_best{level - 1}" if level else ""
        parts.append(f"""
{p}_sums{level} AS (
  SELECT k, n, theta, CAST(0 AS BIGINT) AS j, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b,
         CAST(0 AS DOUBLE) AS aa, CAST(0 AS DOUBLE) AS ab, CAST(0 AS DOUBLE) AS bb FROM {p}_tried{level}
  UNION ALL
  SELECT r.k, r.n, r.theta, r.j + 1, q.now - r.theta * r.a, q.before - r.theta * r.b,
         r.aa + (q.now - r.theta * r.a) * (q.now - r.theta * r.a),
         r.ab + (q.now - r.theta * r.a) * (q.before - r.theta * r.b),
         r.bb + (q.before - r.theta * r.b) * (q.before - r.theta * r.b)
  FROM {p}_sums{level} r JOIN {p}_pairs q ON q.k = r.k AND q.j = r.j + 1),
{p}_best{level} AS (
  SELECT k, n, theta, phi, sse FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY sse, abs(theta), theta, phi) AS place FROM (
      SELECT k, n, theta, phi, greatest(aa - phi * (2 * ab - phi * bb), 0) AS sse FROM (
        SELECT *, CASE WHEN bb = 0 THEN CAST(0 AS DOUBLE) ELSE {slope} END AS phi FROM {p}_sums{level} WHERE j = n - 2){before}))
  WHERE place = 1)""")
    parts.append(f"""
{p}_r2 AS (
  SELECT k, n, theta, phi, CAST(0 AS BIGINT) AS j, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS sse FROM {p}_best10
  UNION ALL
  SELECT r.k, r.n, r.theta, r.phi, r.j + 1, q.now - r.phi * q.before - r.theta * r.e,
         r.sse + (q.now - r.phi * q.before - r.theta * r.e) * (q.now - r.phi * q.before - r.theta * r.e)
  FROM {p}_r2 r JOIN {p}_pairs q ON q.k = r.k AND q.j = r.j + 1),
{p}_b111 AS (
  SELECT k, n, '111' AS ord, phi, theta, CAST(0 AS DOUBLE) AS const, sse, n - 2 AS cnt, e FROM {p}_r2 WHERE j = n - 2)""")
    return ",".join(parts)


def single_move_ctes(p: str) -> str:
    """(0,1,1) of two points: their move is the residual whatever theta is, so theta is 0."""
    return f"""
{p}_b011 AS (
  SELECT k, n, '011' AS ord, CAST(0 AS DOUBLE) AS phi, CAST(0 AS DOUBLE) AS theta, CAST(0 AS DOUBLE) AS const,
         w * w AS sse, CAST(1 AS BIGINT) AS cnt, w AS e FROM {p}_w WHERE n = 2 AND t = 2)"""


def regression_ctes(p: str, s: str, condition: str, constant: bool, skip: int = 0) -> str:
    """(1,0,0) by least squares on (v, value before)."""
    slope = ("sum((before - mx) * (now - my)) / nullif(sum((before - mx) * (before - mx)), 0)" if constant
             else "sum(now * before) / nullif(sum(before * before), 0)")
    bounded = f"CASE WHEN {slope} IS NOT NULL THEN least(greatest({slope}, -0.95), 0.95) END" if constant else slope
    return f"""
{p}_lagged AS (
  SELECT k, n, t, now, before, avg(before) OVER (PARTITION BY k) AS mx, avg(now) OVER (PARTITION BY k) AS my
  FROM (SELECT k, n, t, v AS now, lag(v) OVER (PARTITION BY k ORDER BY t) AS before FROM {s} WHERE {condition})
  WHERE t >= 2),
{p}_line AS (
  SELECT k, n, phi, {'my - phi * mx' if constant else 'CAST(0 AS DOUBLE)'} AS const
  FROM (SELECT k, n, {bounded} AS phi, max(mx) AS mx, max(my) AS my FROM {p}_lagged GROUP BY k, n) WHERE phi IS NOT NULL),
{p}_b100 AS (
  SELECT l.k, l.n, '100' AS ord, phi, CAST(0 AS DOUBLE) AS theta, const,
         sum((now - const - phi * before) * (now - const - phi * before)) AS sse, l.n - {1 + skip} AS cnt, CAST(0 AS DOUBLE) AS e
  FROM {p}_line l JOIN {p}_lagged g ON g.k = l.k WHERE g.t > {1 + skip} GROUP BY ALL)"""


def mean_ctes(p: str, s: str, condition: str, skip: int = 0) -> str:
    return f"""
{p}_b000 AS (
  SELECT k, n, '000' AS ord, CAST(0 AS DOUBLE) AS phi, CAST(0 AS DOUBLE) AS theta, m AS const,
         sum((v - m) * (v - m)) AS sse, n - {skip} AS cnt, CAST(0 AS DOUBLE) AS e
  FROM (SELECT *, avg(v) OVER (PARTITION BY k) AS m FROM {s}) WHERE ({condition}) AND t > {skip} GROUP BY k, n, m)"""


def step_ctes(p: str, s: str, periods: int = PERIODS, naive: bool = True) -> str:
    """Future values of <p>_fit, and the naive forecast for keys without a fit."""
    rest = f"""
  UNION ALL SELECT k, h, predicted, lower, upper FROM {p}_naive_steps WHERE k NOT IN (SELECT k FROM {p}_fit)""" if naive else ""
    return f"""
{p}_last AS (
  SELECT f.*, y.v AS y_last, y.v - x.v AS w_last
  FROM {p}_fit f JOIN {s} y ON y.k = f.k AND y.t = f.n LEFT JOIN {s} x ON x.k = f.k AND x.t = f.n - 1),
{p}_future AS (
  SELECT k, ord, phi, theta, const, sse, cnt, 1 AS h,
         CASE WHEN ord LIKE '_1_' THEN phi * w_last + theta * e ELSE 0 END AS w,
         CASE WHEN ord LIKE '_1_' THEN y_last + (phi * w_last + theta * e) ELSE const + phi * y_last END AS level,
         phi + theta AS c, CAST(1 AS DOUBLE) AS psi, CAST(1 AS DOUBLE) AS weight
  FROM {p}_last
  UNION ALL
  SELECT k, ord, phi, theta, const, sse, cnt, h + 1, phi * w,
         CASE WHEN ord LIKE '_1_' THEN level + phi * w ELSE const + phi * level END,
         phi * c,
         CASE WHEN ord LIKE '_1_' THEN psi + c ELSE phi * psi END,
         weight + CASE WHEN ord LIKE '_1_' THEN (psi + c) * (psi + c) ELSE (phi * psi) * (phi * psi) END
  FROM {p}_future WHERE h < {periods}),
{p}_moves AS (
  SELECT k, sqrt(avg(d * d)) AS moved FROM (SELECT k, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS d FROM {s}) GROUP BY k),
{p}_steps AS (
  SELECT k, h, level AS predicted, level - sqrt(weight) * sigma * 1.96 AS lower,
         level + sqrt(weight) * sigma * 1.96 AS upper
  FROM (SELECT f.*, CASE WHEN sse <= 1e-9 THEN moved ELSE sqrt(sse / cnt) END AS sigma
        FROM {p}_future f JOIN {p}_moves USING (k)){rest})"""


def arima_ctes(p: str, s: str = "s", seasonal: bool = False, periods: int = PERIODS) -> str:
    """(1,1,1) fits every finite series of three points on, (0,1,1) those of two; the other orders are never reached."""
    return ",".join([
        naive_ctes(p + "_naive", s, periods),
        search_ctes(p, s, 1.0 if seasonal else 0.95, not seasonal),
        single_move_ctes(p),
        f"""
{p}_fit AS (SELECT * FROM {p}_b111 UNION ALL SELECT * FROM {p}_b011)""",
        step_ctes(p, s, periods)])


MODEL_CTES = {
    "arima": lambda p, s="s", periods=PERIODS: arima_ctes(p, s, False, periods),
    "sarima": lambda p, s="s", periods=PERIODS: arima_ctes(p, s, True, periods),
    "lstm": lstm_ctes,
}


# -- shapes ---------------------------------------------------------------------

def clamped(p: str) -> str:
    return (f"round(greatest(predicted, 0), 6) AS predicted_enrolments, round(greatest(lower, 0), 6) AS lower_ci, "
            f"round(greatest(upper, greatest(predicted, 0)), 6) AS upper_ci")


def raw(p: str) -> str:
    return "round(predicted, 6) AS predicted_enrolments, round(lower, 6) AS lower_ci, round(upper, 6) AS upper_ci"


def future(p: str, figures: str, extra: str, s: str = "s", where: str = "true", year: bool = True) -> str:
    shown = "CAST(y AS INTEGER) AS year, " if year else ""
    return f"""SELECT {label('y')} AS academic_year, {shown}{figures}, {extra}
               FROM (SELECT f.*, last_year + h AS y FROM {p}_steps f
                     JOIN (SELECT DISTINCT k, n, last_year FROM {s}) USING (k) WHERE {where})"""


def per_provider(model: str, ctes: str, figures: str = "clamped") -> str:
    shown = clamped("m") if figures == "clamped" else raw("m")
    return star(future("m", shown, f"'{model}' AS model_type, k AS provider_key"), PROVIDER_SERIES + "," + ctes)


def one_forecast(model: str, where: str, provider: str = "CAST(NULL AS BIGINT)") -> str:
    return star(future("m", clamped("m"), f"'{model.upper()}' AS model_type, {provider} AS provider_key", where="n >= 2"),
                one_series(where) + "," + MODEL_CTES[model]("m"))


def ssa_rows(model: str, where: str) -> str:
    """Subject-area forecasts labelled from the newest year of all."""
    return star(f"""
        SELECT {label('y')} AS academic_year, k AS ssa_tier1, {clamped('m')}, '{model.upper()}' AS model_type
        FROM (SELECT *, (SELECT max(year) FROM s) + h AS y FROM m_steps)""",
        ssa_series(where) + "," + MODEL_CTES[model]("m"))


SLICE = f"provider_skey = {SLICE_PROVIDER} AND funding = '{SLICE_FUNDING}'"

WITH_HISTORY = star(f"""
    SELECT academic_year, CAST(v AS DOUBLE) AS learner_count, 'Historical' AS data_type,
           CAST(NULL AS DOUBLE) AS lower_ci, CAST(NULL AS DOUBLE) AS upper_ci, CAST(NULL AS VARCHAR) AS model_type
    FROM (SELECT {label('year')} AS academic_year, v FROM s)
    UNION ALL
    SELECT academic_year, predicted_enrolments, 'Forecast', lower_ci, upper_ci, 'SARIMA'
    FROM ({future("m", clamped("m"), "1 AS one", where="n >= 2")})""",
    one_series(SLICE) + "," + arima_ctes("m", "s", True))

COMPARED = star(" UNION ALL ".join(
    future(m, clamped(m), f"'{m.upper()}' AS model_type, CAST({SLICE_PROVIDER} AS BIGINT) AS provider_key", where="n >= 2")
    for m in MODEL_CTES), one_series(SLICE) + "," + ",".join(MODEL_CTES[m](m) for m in MODEL_CTES))

VALUES = "CAST(last_year + h AS INTEGER) AS year, {0} AS forecast_learner_count"

HOLT = """
m_holt AS (
  SELECT k, t, n, last_year, v AS level, CAST(NULL AS DOUBLE) AS trend FROM s WHERE t = 1 AND n > 1
  UNION ALL
  SELECT s.k, s.t, s.n, s.last_year,
         CAST(0.3 AS DOUBLE) * s.v + CAST(0.7 AS DOUBLE) * (h.level + coalesce(h.trend, s.v - h.level)),
         CAST(0.1 AS DOUBLE) * ((CAST(0.3 AS DOUBLE) * s.v + CAST(0.7 AS DOUBLE) * (h.level + coalesce(h.trend, s.v - h.level))) - h.level)
         + CAST(0.9 AS DOUBLE) * coalesce(h.trend, s.v - h.level)
  FROM m_holt h JOIN s ON s.k = h.k AND s.t = h.t + 1)"""

TRAIN_SSA = star(f"""
    SELECT {label('y')} AS academic_year, k AS ssa_tier1, round(greatest(predicted, 0), 6) AS predicted_enrolments,
           round(greatest(lower, 0), 6) AS lower_ci, round(upper, 6) AS upper_ci, model_type
    FROM (SELECT f.*, last_year + h AS y FROM m_steps f JOIN (SELECT DISTINCT k, last_year FROM s) USING (k)),
         (VALUES ('ARIMA'), ('SARIMA'), ('LSTM')) AS names(model_type)""",
    series("s", "SELECT ssa_tier1 AS k, year, learner_count AS v FROM by_ssa WHERE ssa_tier1 IS NOT NULL") + ","
    + regression_ctes("m", "s", "n >= 3", True) + "," + mean_ctes("m", "s", "n = 2")
    + ", m_fit AS (SELECT * FROM m_b100 UNION ALL SELECT * FROM m_b000)," + step_ctes("m", "s", naive=False))

def lag_sum(weights: str, values: str, t: str, var: str = "j") -> str:
    """Weights times the values before place t, one after the other."""
    return (f"list_reduce([CAST(0 AS DOUBLE)] || list_transform(range(1, len({weights}) + 1), "
            f"lambda {var}: {weights}[{var}] * {values}[{t} - {var}]), lambda {var}1, {var}2: {var}1 + {var}2)")


def list_total(values: str, var: str) -> str:
    return f"list_reduce([CAST(0 AS DOUBLE)] || {values}, lambda {var}1, {var}2: {var}1 + {var}2)"


def raised(weights: str, reflection: str, var: str = "i") -> str:
    return (f"list_transform(range(1, len({weights}) + 1), lambda {var}: {weights}[{var}] - {reflection} * {weights}[len({weights}) + 1 - {var}])"
            f" || [{reflection}]")


# Every recursion is one of rows: a fit is a row that carries its lists from step to step.
CANDIDATE_CTES = ",".join([PROVIDER_SERIES, f"""
o_y AS (SELECT k, n, list(v ORDER BY t) AS y FROM s WHERE n >= 3 GROUP BY k, n),
o_every AS (
  SELECT k, n, y, p, d, q, CASE WHEN q > 0 THEN greatest(p, q) ELSE 0 END AS m, {list_total('y', 'x')} / n AS avg_y
  FROM o_y, range(4) AS a(p), range(3) AS b(d), range(4) AS c(q)),
o_x AS (
  SELECT k, n, p, d, q, m, CASE WHEN q > 0 THEN m + q ELSE p END AS skipped, CASE WHEN d = 0 THEN avg_y ELSE CAST(0 AS DOUBLE) END AS const,
    CASE d WHEN 0 THEN list_transform(y, lambda v: v - avg_y)
      WHEN 1 THEN list_transform(range(2, n + 1), lambda i: y[i] - y[i - 1])
      ELSE list_transform(range(3, n + 1), lambda i: (y[i] - y[i - 1]) - (y[i - 1] - y[i - 2])) END AS x
  FROM o_every WHERE n - d - CASE WHEN q > 0 THEN m + q ELSE p END > p + q),
o_g AS (
  SELECT *, list_transform(range(0, m + 1), lambda h: {list_total('list_transform(range(h + 1, len(x) + 1), lambda t: x[t] * x[t - h])', 'u')} / len(x)) AS g
  FROM o_x),
o_long AS (
  SELECT k, p, d, q, m, g, x, const, skipped, n, 0 AS step, CAST([] AS DOUBLE[]) AS a, g[1] AS v FROM o_g
  UNION ALL
  SELECT * EXCLUDE (r, a, v), {raised('a', 'r')}, v * (1 - r * r) FROM (
    SELECT k, p, d, q, m, g, x, const, skipped, n, step + 1 AS step, a, v,
      (g[step + 2] - {lag_sum('a', 'g', '(step + 2)')}) / nullif(v, 0) AS r FROM o_long WHERE step < m)),
o_e AS (
  SELECT *, list_transform(range(1, len(x) + 1), lambda t: CASE WHEN t <= m THEN CAST(0 AS DOUBLE) ELSE x[t] - {lag_sum('a', 'x', 't')} END) AS e
  FROM o_long WHERE step = m),
o_z AS (
  SELECT *, list_transform(range(skipped + 1, len(x) + 1), lambda t: list_transform(range(1, p + 1), lambda i: x[t - i])
    || list_transform(range(1, q + 1), lambda i: e[t - i]) || [x[t]]) AS z FROM o_e),
o_m AS (
  SELECT k, p, d, q, x, const, n, list_transform(range(1, p + q + 1), lambda i: list_transform(range(1, p + q + 2),
    lambda j: {list_total('list_transform(z, lambda r: r[i] * r[j])', 'u')})) AS mat FROM o_z),
o_solve AS (
  SELECT k, p, d, q, x, const, n, mat, list_transform(range(1, p + q + 1), lambda i: mat[i][i]) AS diagonal, 0 AS step FROM o_m
  UNION ALL
  SELECT k, p, d, q, x, const, n, list_transform(range(1, p + q + 1), lambda i: CASE WHEN i = step + 1 THEN unit
      ELSE list_transform(range(1, p + q + 2), lambda j: mat[i][j] - mat[i][step + 1] * unit[j]) END), diagonal, step + 1
  FROM (SELECT *, list_transform(mat[step + 1], lambda v: v / mat[step + 1][step + 1]) AS unit FROM o_solve
        WHERE step < p + q AND mat[step + 1][step + 1] > 1e-8 * diagonal[step + 1])),
o_fit AS (
  SELECT k, p, d, q, x, const, n, list_transform(range(1, p + 1), lambda i: mat[i][p + q + 1]) AS phi,
    list_transform(range(p + 1, p + q + 1), lambda i: mat[i][p + q + 1]) AS theta FROM o_solve WHERE step = p + q),
o_down AS (
  SELECT k, p, d, q, 'phi' AS side, phi AS a, CAST([] AS DOUBLE[][]) AS levels FROM o_fit
  UNION ALL SELECT k, p, d, q, 'theta', list_transform(theta, lambda v: -v), CAST([] AS DOUBLE[][]) FROM o_fit
  UNION ALL
  SELECT k, p, d, q, side, list_transform(range(1, len(a)), lambda j: (a[j] + a[len(a)] * a[len(a) - j]) / (1 - a[len(a)] * a[len(a)])),
    [a] || levels FROM o_down WHERE len(a) > 0 AND abs(a[len(a)]) < 1 - 1e-9),
o_ends AS (SELECT * FROM o_down WHERE len(a) = 0),
o_good AS (
  SELECT f.*, u.levels FROM o_fit f JOIN o_ends u ON (u.k, u.p, u.d, u.q) = (f.k, f.p, f.d, f.q) AND u.side = 'phi'
  JOIN o_ends w ON (w.k, w.p, w.d, w.q) = (f.k, f.p, f.d, f.q) AND w.side = 'theta'),
o_own AS (
  SELECT k, p, d, q, x, const, n, phi, theta, levels,
    [1.0 / list_reduce([CAST(1 AS DOUBLE)] || list_transform(levels, lambda b: 1 - b[len(b)] * b[len(b)]), lambda u1, u2: u1 * u2)] AS g FROM o_good
  UNION ALL
  SELECT k, p, d, q, x, const, n, phi, theta, levels, g || [{lag_sum('w', 'g', '(len(g) + 1)')}]
  FROM (SELECT *, coalesce(levels[len(g)], phi) AS w FROM o_own WHERE len(g) < len(x) + q + 1)),
o_cov AS (
  SELECT k, p, d, q, x, const, n, phi, theta, list_transform(range(0, len(x) + 1), lambda h: {list_total(
      'flatten(list_transform(range(0, q + 1), lambda i: list_transform(range(0, q + 1), lambda j: moving[i + 1] * moving[j + 1] * g[abs(h - i + j) + 1])))', 'u')}) AS g
  FROM (SELECT *, [CAST(1 AS DOUBLE)] || theta AS moving FROM o_own WHERE len(g) = len(x) + q + 1)),
o_steps AS (
  SELECT k, p, d, q, x, const, n, phi, theta, g, CAST([] AS DOUBLE[]) AS a, g[1] AS v, 0 AS t, CAST([] AS DOUBLE[]) AS errors, CAST([] AS DOUBLE[]) AS spreads FROM o_cov
  UNION ALL
  SELECT k, p, d, q, x, const, n, phi, theta, g, {raised('a', 'r')}, v * (1 - r * r), t + 1,
    errors || [x[t + 1] - {lag_sum('a', 'x', '(t + 1)')}], spreads || [v]
  FROM (SELECT *, (g[t + 2] - {lag_sum('a', 'g', '(t + 2)')}) / v AS r FROM o_steps WHERE t < len(x))),
o_sums AS (
  SELECT *, {list_total('list_transform(range(3 - d, len(x) + 1), lambda i: errors[i] * errors[i] / spreads[i])', 'u')} AS sse,
    {list_total('list_transform(range(3 - d, len(x) + 1), lambda i: ln(spreads[i]))', 'w')} AS logs, p + q + 1 + CASE WHEN d = 0 THEN 1 ELSE 0 END AS params
  FROM o_steps WHERE t = len(x)),
o_like AS (
  SELECT *, greatest(sse, 1e-9) / (n - 2) AS variance,
    -(n - 2) / 2.0 * (ln(2 * pi() * greatest(sse, 1e-9) / (n - 2)) + 1) - logs / 2 AS ll FROM o_sums),
m_scored AS (
  SELECT k AS provider_skey, CAST(p AS VARCHAR) || d || q AS "order", round(phi[1], 6) AS phi_1, round(phi[2], 6) AS phi_2, round(phi[3], 6) AS phi_3,
    round(theta[1], 6) AS theta_1, round(theta[2], 6) AS theta_2, round(theta[3], 6) AS theta_3, round(const, 6) AS const,
    round(variance, 6) AS variance, round(-2 * ll + 2 * params, 6) AS aic, round(-2 * ll + params * ln(n - 2), 6) AS bic,
    round(ll, 6) AS log_likelihood FROM o_like)"""])


def residual_ctes(p: str) -> str:
    """One-step errors of <p>_fit; the test series are all long enough for (1,1,1)."""
    return f"""
{p}_errors AS (
  SELECT f.k, CAST(0 AS BIGINT) AS j, CAST(0 AS DOUBLE) AS e, CAST(NULL AS DOUBLE) AS actual, f.phi, f.theta FROM {p}_fit f
  UNION ALL
  SELECT r.k, q.j, q.now - r.phi * q.before - r.theta * r.e, s.v, r.phi, r.theta
  FROM {p}_errors r JOIN {p}_pairs q ON q.k = r.k AND q.j = r.j + 1 JOIN s ON s.k = r.k AND s.t = q.j + 2)"""


def metric_rows(model: str) -> str:
    return f"""SELECT k AS provider_skey, '111' AS "order", round(avg(abs(e)), 2) AS mae, round(sqrt(avg(e * e)), 2) AS rmse,
                      round(avg(abs(e / actual)) * 100, 2) AS mape, '{model.upper()}' AS model,
                      count(*) + 2 AS data_points, CAST(3 AS BIGINT) AS forecast_periods
               FROM {model}_errors WHERE j > 0 GROUP BY k"""


METRICS = star(f"""{metric_rows('arima')} UNION ALL {metric_rows('sarima')} UNION ALL
    SELECT DISTINCT k, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'LSTM', n, CAST(3 AS BIGINT)
    FROM s""", ",".join([PROVIDER_SERIES, arima_ctes("arima"), arima_ctes("sarima", "s", True),
                         residual_ctes("arima"), residual_ctes("sarima")]))

TOTAL_SERIES = series("s", "SELECT 0 AS k, year, total_learners AS v FROM trends")
TOTAL_METRICS = star(f"""
    SELECT * EXCLUDE (provider_skey) FROM ({metric_rows('arima')} UNION ALL {metric_rows('sarima')} UNION ALL
    SELECT DISTINCT k, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'LSTM', n, CAST(3 AS BIGINT)
    FROM s)""", ",".join([TOTAL_SERIES, arima_ctes("arima"), arima_ctes("sarima", "s", True),
                          residual_ctes("arima"), residual_ctes("sarima")]))

BACKTEST = star(" UNION ALL ".join(f"""
    SELECT f.k AS provider_skey, '{m.upper()}' AS model_type, round(avg(abs(a.v - predicted)), 6) AS mae,
           round(sqrt(avg((a.v - predicted) * (a.v - predicted))), 6) AS rmse,
           round(avg(abs((a.v - predicted) / a.v)) * 100, 6) AS mape
    FROM {m}_steps f JOIN full_s a ON a.k = f.k AND a.t = a.n - {HOLD_OUT} + f.h GROUP BY f.k""" for m in MODEL_CTES),
    ",".join([PROVIDER_SERIES.replace("\ns AS", "\nfull_s AS"),
              series("s", f"SELECT k, year, v FROM full_s WHERE t <= n - {HOLD_OUT}"),
              *[MODEL_CTES[m](m, "s", HOLD_OUT) for m in MODEL_CTES]]))

LSTM_ROWS = "'LSTM' AS model_type, CAST(k AS BIGINT) AS provider_key"
SLICE_ROWS = f"'LSTM' AS model_type, CAST({SLICE_PROVIDER} AS BIGINT) AS provider_key"
RESOLVED = star(
    f"SELECT 'filtered' AS source, * FROM ({future('m', clamped('m'), SLICE_ROWS, where='n >= 2')})"
    + "".join(
        f" UNION ALL SELECT '{source}', * FROM "
        f"({future('a', clamped('a'), LSTM_ROWS, s='p', where=f'k = {SLICE_PROVIDER}')})"
        for source in ("stored", "saved", "computed")),
    ",".join([one_series(SLICE), lstm_ctes("m"), PROVIDER_SERIES.replace("\ns AS", "\np AS"), lstm_ctes("a", "p")]))

PIVOT_YEARS = ("22/23", "23/24", "24/25")

FORECASTS = {
    "forecast_naive": per_provider("NAIVE", naive_ctes("m")),
    "forecast_lstm_proxy": per_provider("LSTM", lstm_ctes("m")),
    "forecast_lstm_saved": per_provider("LSTM", saved_ctes("m"), "raw"),
    "forecast_arima": per_provider("ARIMA", arima_ctes("m")),
    "forecast_sarima": per_provider("SARIMA", arima_ctes("m", "s", True)),
    "provider_forecast": one_forecast("sarima", f"provider_skey = {SLICE_PROVIDER}", f"CAST({SLICE_PROVIDER} AS BIGINT)"),
    "provider_forecast_short": one_forecast("arima", f"year BETWEEN {SHORT_FIRST} AND {SHORT_LAST} AND location = '{TOWN}'"),
    "provider_forecast_middle": one_forecast("sarima", f"year BETWEEN {MIDDLE_FIRST} AND {MIDDLE_LAST}"),
    "ssa_forecast": ssa_rows("sarima", "true"),
    "ssa_forecast_filtered": ssa_rows("arima", f"year BETWEEN {SHORT_FIRST} AND {SHORT_LAST} AND location = '{TOWN}'"),
    "ssa_forecast_saved": ssa_rows("arima", "true"),
    "train_ssa_forecast": TRAIN_SSA,
    "forecast_linear": star("""
        SELECT k AS provider_skey, CAST(last_year + h AS INTEGER) AS year,
               round(my + slope * (last_year + h - mx), 6) AS predicted_learner_count,
               coalesce(growth, 0) AS growth_rate, 'Forecast' AS trend
        FROM (SELECT k, last_year, avg(year) AS mx, avg(v) AS my, coalesce(regr_slope(v, year), 0) AS slope,
                     round_even(100.0 * (max(CASE WHEN t = n THEN v END) - max(CASE WHEN t = n - 1 THEN v END))
                       / max(CASE WHEN t = n - 1 THEN v END), 2) AS growth
              FROM s GROUP BY k, last_year), range(1, 4) AS r(h)""", PROVIDER_SERIES),
    "exp_smoothing": star("""
        SELECT k AS provider_skey, CAST(s.year AS INTEGER) AS year, m_smooth.v AS value, smoothed
        FROM m_smooth JOIN s USING (k, t)""", PROVIDER_SERIES + "," + smooth_cte("m_smooth", 0.3)),
    "forecast_holt": star(f"""
        SELECT k AS provider_skey, {VALUES.format('level + trend * h')}
        FROM m_holt, range(1, 4) AS r(h) WHERE t = n""", PROVIDER_SERIES + "," + HOLT),
    "holt_components": star("""
        SELECT h.k AS provider_skey, CAST(s.year AS INTEGER) AS year, level,
               coalesce(trend, (SELECT s2.v - s.v FROM s s2 WHERE s2.k = s.k AND s2.t = 2)) AS trend
        FROM m_holt h JOIN s ON s.k = h.k AND s.t = h.t""", PROVIDER_SERIES + "," + HOLT),
    "forecast_ema": star(f"""
        SELECT k AS provider_skey, {VALUES.format('level + slope * h')}
        FROM (SELECT m_smooth.k, last_year, max(CASE WHEN m_smooth.t = m_smooth.n THEN smoothed END) AS level,
                     (max(CASE WHEN m_smooth.t = m_smooth.n THEN smoothed END) - max(CASE WHEN m_smooth.t = 1 THEN smoothed END))
                       / (m_smooth.n - 1) AS slope
              FROM m_smooth JOIN s USING (k, t) GROUP BY m_smooth.k, last_year, m_smooth.n), range(1, 4) AS r(h)""",
        PROVIDER_SERIES + "," + smooth_cte("m_smooth", 0.3)),
    "forecast_sma": star(f"""
        SELECT k AS provider_skey, CAST(last_year + h AS INTEGER) AS year, round(level, 6) AS forecast_learner_count
        FROM (SELECT k, last_year, CASE WHEN n >= 3 THEN avg(CASE WHEN t > n - 3 THEN v END) END AS level
              FROM s GROUP BY k, last_year, n), range(1, 4) AS r(h)""", PROVIDER_SERIES),
    "order_selection": star("""
        SELECT * EXCLUDE (place) FROM (
          SELECT *, row_number() OVER (PARTITION BY provider_skey ORDER BY aic, "order") AS place FROM m_scored)
        WHERE place = 1""", CANDIDATE_CTES),
    "order_candidates": star("SELECT * FROM m_scored", CANDIDATE_CTES),
    "forecast_metrics": METRICS,
    "forecast_backtest": BACKTEST,
    "history_with_forecast": WITH_HISTORY,
    "forecast_combined_export": star(f"""
        SELECT CAST(year AS INTEGER) AS year, v AS learner_count, 'Historical' AS data_type FROM s
        UNION ALL
        SELECT {VALUES.format('level + trend * h')}, 'Forecast' FROM m_holt, range(1, 4) AS r(h) WHERE t = n""",
        series("s", "SELECT 0 AS k, year, sum(learner_count) AS v FROM by_provider GROUP BY year") + "," + HOLT),
    "compare_models": COMPARED,
    "ssa_forecast_pivot": star(f"""
        SELECT k AS subject_area, """ + ", ".join(
            f"""CAST(round_even(coalesce(sum(CASE WHEN h = {i} THEN greatest(predicted, 0) END), 0), 0) AS BIGINT) AS "{y}" """
            for i, y in enumerate(PIVOT_YEARS, start=1)) + " FROM m_steps GROUP BY k",
        ssa_series("true") + "," + arima_ctes("m", "s", True)),
    "forecast_resolve": RESOLVED,
    "ssa_forecast_map": star(f"""
        SELECT k AS ssa_tier1, {label('y')} AS academic_year, round(greatest(predicted, 0), 6) AS predicted
        FROM (SELECT *, (SELECT max(year) FROM s) + h AS y FROM m_steps)""",
        ssa_series("true") + "," + arima_ctes("m", "s", True)),
}

# -- storage --------------------------------------------------------------------

EXTRACT_COUNTS = """
    SELECT 'enrolment_total' AS name, count(*) AS row_count FROM trends
    UNION ALL SELECT 'enrolment_by_ssa', count(*) FROM by_ssa
    UNION ALL SELECT 'enrolment_by_provider', count(*) FROM by_provider
    UNION ALL SELECT 'enrolment_by_age', count(*) FROM (SELECT DISTINCT academic_year, age_group_fes FROM enrolled)
    UNION ALL SELECT 'enrolment_by_level', count(*) FROM (SELECT DISTINCT academic_year, level_description FROM enrolled)"""

PROFILED = ("lineitem", "orders", "supplier", "nation")
_COLUMNS = {
    "lineitem": (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")),
    "orders": (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
               ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")),
    "supplier": (("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")),
    "nation": (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")),
}


def profile_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{name}' AS column_name, CAST({place} AS INTEGER) AS ordinal_position,
                   '{kind}' AS data_type, count(*) AS row_count, count(*) - count({name}) AS null_count,
                   count(DISTINCT {name}) AS distinct_count FROM {table}"""
        for table in PROFILED for place, (name, kind) in enumerate(_COLUMNS[table], start=1))


STORAGE = {
    "refresh_extracts": star(EXTRACT_COUNTS),
    "forecast_store_roundtrip": star(f"""
        SELECT {label('last_year + h')} AS academic_year, {clamped('m')}, 'SARIMA' AS model_type, k AS provider_key, run
        FROM m_steps JOIN (SELECT DISTINCT k, last_year FROM s) USING (k), (VALUES ('all'), ('all'), ('latest')) AS runs(run)""",
        PROVIDER_SERIES + "," + arima_ctes("m", "s", True)),
    "forecast_saved_read": star(future("m", clamped("m"), "'LSTM' AS model_type, k AS provider_key",
                                       where=f"k = {SLICE_PROVIDER}"), PROVIDER_SERIES + "," + lstm_ctes("m")),
    "model_accuracy": TOTAL_METRICS,
    "train_all_counts": star("""
        SELECT 'arima' AS model, CAST(3 AS BIGINT) AS row_count FROM (SELECT 1 FROM trends LIMIT 1)
        UNION ALL SELECT 'sarima', CAST(3 AS BIGINT) FROM (SELECT 1 FROM trends LIMIT 1)
        UNION ALL SELECT 'lstm', CAST(3 AS BIGINT) FROM (SELECT 1 FROM trends LIMIT 1)
        UNION ALL SELECT 'ssa', 3 * count(*) FROM (SELECT ssa_tier1 FROM by_ssa WHERE ssa_tier1 IS NOT NULL
                                                   GROUP BY ssa_tier1 HAVING count(*) > 1)"""),
    "export_star_model": star("""
        SELECT 'fact_enrolment' AS name, count(*) AS row_count FROM fact_enrolment
        UNION ALL SELECT 'dim_date', CAST(12 * (max(year(o_orderdate)) - min(year(o_orderdate)) + 1) AS BIGINT)
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 'dim_ssa', count(*) FROM dim_ssa UNION ALL SELECT 'dim_age', count(*) FROM dim_age
        UNION ALL SELECT 'dim_provider', count(*) FROM dim_provider
        UNION ALL SELECT 'fact_forecast', 3 * count(DISTINCT provider_skey) FROM by_provider"""),
    "table_profile": profile_sql(),
    "stored_star_trends": star(f"""
        SELECT academic_year, total_learners, total_enrolments FROM trends
        WHERE year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}"""),
    "offline_exports": star("""
        SELECT 'enrolment_summary' AS name, count(*) AS row_count, (SELECT n FROM whole) AS learners FROM trends
        UNION ALL SELECT 'ssa_breakdown', count(*), (SELECT n FROM whole) FROM (SELECT DISTINCT academic_year, ssa_tier_1_description FROM enrolled WHERE ssa_tier_1_description IS NOT NULL)
        UNION ALL SELECT 'enrolment_trends', count(*), CAST(sum(total_learners) AS BIGINT) FROM trends
        UNION ALL SELECT 'age_breakdown', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT learner_skey) AS n FROM enrolled GROUP BY academic_year, age_group_fes)
        UNION ALL SELECT 'funding_trends', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT learner_skey) AS n FROM enrolled GROUP BY academic_year, funding)
        UNION ALL SELECT 'forecast_combined', count(*) + 3, (SELECT n FROM whole) FROM trends
        UNION ALL SELECT 'kpi_metrics', CAST(1 AS BIGINT), (SELECT n FROM whole) FROM (SELECT 1 FROM trends LIMIT 1)
        UNION ALL SELECT 'model_results', CAST(5 AS BIGINT), CAST(NULL AS BIGINT) FROM training HAVING count(*) > 20""",
        """training AS (
          SELECT academic_year, provider_name, college_type, ssa_tier_1_description, ssa_tier_2_description, level, funding,
                 age_group_fes, count(DISTINCT learner_skey) AS learner_count FROM enrolled GROUP BY ALL),
        whole AS (SELECT CAST(sum(learner_count) AS BIGINT) AS n FROM training)"""),
}

# -- preparation ------------------------------------------------------------------

CLEAN = star("""
    SELECT academic_year, coalesce(ssa, (SELECT mode_ssa FROM fills)) AS ssa_tier_1_description,
           coalesce(CAST(enrolment_count AS DOUBLE), (SELECT med_count FROM fills)) AS enrolment_count,
           coalesce(CAST(hours AS DOUBLE), (SELECT med_hours FROM fills)) AS guided_learning_hours, learner_skey
    FROM distinct_rows""",
    """distinct_rows AS (
      SELECT DISTINCT academic_year, ssa_tier_1_description AS ssa, enrolment_count,
             guided_learning_hours AS hours, learner_skey FROM enrolled),
    fills AS (
      SELECT median(enrolment_count) AS med_count, median(hours) AS med_hours,
             (SELECT ssa FROM distinct_rows WHERE ssa IS NOT NULL GROUP BY ssa ORDER BY count(*) DESC, ssa LIMIT 1) AS mode_ssa
      FROM distinct_rows)""")

TRAINING = """training AS (
  SELECT academic_year, provider_name, college_type AS provider_type, ssa_tier_1_description AS ssa_tier1,
         ssa_tier_2_description AS ssa_tier2, level AS qual_level, funding AS funding_type_desc,
         age_group_fes AS age_group, count(DISTINCT learner_skey) AS learner_count
  FROM enrolled GROUP BY ALL)"""

CODE_COLUMNS = ("provider_name", "ssa_tier1", "age_group")
_codes = ", ".join(
    f"""code_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
        FROM (SELECT DISTINCT coalesce({c}, 'None') AS v FROM training))""" for c in CODE_COLUMNS)

FEATURES = ("provider_name", "provider_type", "ssa_tier1", "ssa_tier2", "qual_level", "funding_type_desc", "age_group")
_SIZE = len(FEATURES) + 1  # with the year


def _mode(c: str) -> str:
    return (f"coalesce({c}, (SELECT {c} FROM training WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), 'Unknown')")


# Normal equations by elimination, lasso by 400 sweeps of coordinate descent, each step a row.
REGRESSION = TRAINING + f""",
filled AS (SELECT academic_year, learner_count, {", ".join(f"{_mode(c)} AS {c}" for c in FEATURES)} FROM training),
{", ".join(f"""number_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT {c} AS v FROM filled))""" for c in FEATURES)},
points AS (
  SELECT academic_year, [{", ".join(f"number_{c}.code" for c in FEATURES)}, CAST(2000 + CAST(left(academic_year, 2) AS INTEGER) AS DOUBLE),
      CAST(learner_count AS DOUBLE)] AS x,
    CAST('0x' || substr(md5(concat_ws('|', academic_year, {", ".join(FEATURES)})), 1, 8) AS BIGINT) % 100 < 80 AS train
  FROM filled {" ".join(f"JOIN number_{c} ON number_{c}.v = {c}" for c in FEATURES)}),
numbers AS (
  SELECT (SELECT count(*) FROM points WHERE train) AS n, (SELECT list(m ORDER BY i) FROM (
      SELECT i, avg(x[i]) AS m FROM points, range(1, {_SIZE + 2}) AS a(i) WHERE train GROUP BY i)) AS means,
    (SELECT list(row ORDER BY i) FROM (SELECT i, list(c ORDER BY j) AS row FROM (
      SELECT i, j, covar_pop(x[i], x[j]) AS c FROM points, range(1, {_SIZE + 2}) AS a(i), range(1, {_SIZE + 2}) AS b(j) WHERE train GROUP BY i, j)
      GROUP BY i)) AS cov),
penalised AS (
  SELECT model, list_transform(range(1, {_SIZE + 1}), lambda i: list_transform(range(1, {_SIZE + 2}),
    lambda j: cov[i][j] + CASE WHEN i = j THEN ridge / n ELSE 0 END)) AS mat
  FROM numbers, (VALUES ('Linear Regression', 0.0), ('Ridge Regression', 1.0)) AS m(model, ridge)),
solving AS (
  SELECT model, mat, list_transform(range(1, {_SIZE + 1}), lambda i: mat[i][i]) AS diagonal, 0 AS step FROM penalised
  UNION ALL
  SELECT model, list_transform(range(1, {_SIZE + 1}), lambda i: CASE WHEN i = step + 1 THEN unit
      ELSE list_transform(range(1, {_SIZE + 2}), lambda j: mat[i][j] - mat[i][step + 1] * unit[j]) END), diagonal, step + 1
  FROM (SELECT *, list_transform(mat[step + 1], lambda v: CASE WHEN mat[step + 1][step + 1] > 1e-10 * diagonal[step + 1]
          THEN v / mat[step + 1][step + 1] ELSE 0 END) AS unit FROM solving WHERE step < {_SIZE})),
descent AS (
  SELECT cov, list_transform(range({_SIZE}), lambda i: CAST(0 AS DOUBLE)) AS w, 0 AS step FROM numbers
  UNION ALL
  SELECT cov, list_transform(range(1, {_SIZE + 1}), lambda i: CASE WHEN i <> spot OR cov[spot][spot] <= 0 THEN w[i]
      ELSE sign(pull) * greatest(abs(pull) - 0.1, 0) / cov[spot][spot] END), step + 1
  FROM (SELECT *, cov[spot][{_SIZE + 1}] - list_sum(list_transform(range(1, {_SIZE + 1}), lambda k: CASE WHEN k = spot THEN 0 ELSE cov[spot][k] * w[k] END)) AS pull
        FROM (SELECT *, step % {_SIZE} + 1 AS spot FROM descent WHERE step < 400 * {_SIZE}))),
weights AS (
  SELECT model, w, means[{_SIZE + 1}] - list_sum(list_transform(range(1, {_SIZE + 1}), lambda i: w[i] * means[i])) AS b FROM numbers, (
    SELECT model, list_transform(mat, lambda r: r[{_SIZE + 1}]) AS w FROM solving WHERE step = {_SIZE}
    UNION ALL SELECT 'Lasso Regression', w FROM descent WHERE step = 400 * {_SIZE})),
predictions AS (
  SELECT model, academic_year, x[{_SIZE + 1}] AS actual, b + list_sum(list_transform(range(1, {_SIZE + 1}), lambda i: w[i] * x[i])) AS predicted
  FROM points, weights WHERE NOT train)"""

PREPARATION = {
    "regression_predict": star("""
        SELECT academic_year, count(*) AS n, round(avg(actual), 6) AS learners, round(avg(predicted), 6) AS predicted
        FROM predictions WHERE model = 'Linear Regression' GROUP BY academic_year""", REGRESSION),
    "regression_linear_compare": star("""
        SELECT model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(mape, 6) AS mape, rmse = min(rmse) OVER () AS is_best FROM (
          SELECT model, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
                 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2,
                 avg(abs((actual - predicted) / nullif(actual, 0))) * 100 AS mape FROM predictions GROUP BY model)""", REGRESSION),
    "regression_coefficients": star(f"""
        SELECT model, feature, round(coefficient, 6) AS coefficient FROM (
          SELECT model, 'intercept' AS feature, b AS coefficient FROM weights
          UNION ALL SELECT model, names[i], w[i] FROM (SELECT *, [{", ".join(f"'{c}_encoded'" for c in FEATURES)}, 'year'] AS names FROM weights),
            range(1, {_SIZE + 1}) AS a(i))""", REGRESSION),
    "clean_data": CLEAN,
    "label_encode": star(f"""
        SELECT {", ".join(f"t.{c}, code_{c}.code AS {c}_encoded" for c in CODE_COLUMNS)}, count(*) AS n
        FROM training t {" ".join(f"JOIN code_{c} ON code_{c}.v = coalesce(t.{c}, 'None')" for c in CODE_COLUMNS)}
        GROUP BY ALL""", TRAINING + ", " + _codes),
    "scale_standard": star("""
        SELECT provider_skey, year, round((learner_count - avg(learner_count) OVER ()) / stddev_pop(learner_count) OVER (), 6) AS learner_count,
               round((enrolment_count - avg(enrolment_count) OVER ()) / stddev_pop(enrolment_count) OVER (), 6) AS enrolment_count
        FROM by_provider"""),
    "scale_minmax": star("""
        SELECT provider_skey, year,
               round(CAST(learner_count - min(learner_count) OVER () AS DOUBLE) / (max(learner_count) OVER () - min(learner_count) OVER ()), 6) AS learner_count,
               round(CAST(enrolment_count - min(enrolment_count) OVER () AS DOUBLE) / (max(enrolment_count) OVER () - min(enrolment_count) OVER ()), 6) AS enrolment_count
        FROM by_provider"""),
    "train_test_split": star("""
        SELECT CASE WHEN CAST('0x' || substr(md5(concat_ws('|', academic_year, provider_name, provider_type, ssa_tier1,
                 ssa_tier2, qual_level, funding_type_desc, age_group)), 1, 8) AS BIGINT) % 100 < 80
               THEN 'train' ELSE 'test' END AS part, academic_year, count(*) AS n,
               CAST(sum(learner_count) AS BIGINT) AS learners
        FROM training GROUP BY ALL""", TRAINING),
    "feature_summary": star("""
        SELECT count(*) AS total_rows, CAST(9 AS BIGINT) AS total_columns, CAST(1 AS BIGINT) AS numeric_columns,
               CAST(8 AS BIGINT) AS categorical_columns,
               CAST(sum(CASE WHEN ssa_tier1 IS NULL THEN 1 ELSE 0 END + CASE WHEN ssa_tier2 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_values
        FROM training""", TRAINING),
}

FAMILIES = ("FORECASTS", "STORAGE", "PREPARATION")
