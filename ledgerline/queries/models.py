"""Series models, decomposition and diagnostics."""

from pyspark.sql import functions as F

from ..forecast import decompose as D
from ..forecast import diagnostics as G
from ..forecast import models as M
from ..functions import arrays as A
from ..operators import series as O
from ..operators import windows
from ..plans import analysis, quarterly, revenue
from . import query
from . import roles as R
from .joining import PAIRS
from .roles import big, r, rs, txt
from .windowing import PAY_MONTHS, _PK, pay_months

STEPS = 14


def forecast_ctes(src: str, p: str, steps: int, models: list[str], damping: tuple[float, ...] = (1.0,)) -> str:
    """SQL of the models over ``src (k, m, v, i, n)``; leaves ``{p}_f (k, model, h, f)``."""
    alphas = ", ".join(f"(CAST({a} AS DOUBLE))" for a in M.ALPHAS)
    grid = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for c in damping for a in M.HOLT_ALPHAS for b in M.HOLT_BETAS)
    damped = len(damping) > 1
    steps_of = M.DAMPED_STEPS if damped else M.HOLT_STEPS
    ctes = [
        f"{p}_h AS (SELECT CAST(h AS BIGINT) AS h FROM generate_series(1, {steps}) t(h))",
        f"{p}_last AS (SELECT k, MAX(n) AS n, MAX_BY(v, i) AS last, MAX(CASE WHEN i = n - 1 THEN v END) AS prev, AVG(v) AS avg, SUM(CASE WHEN i > n - 12 THEN v ELSE 0 END) AS s1, SUM(CASE WHEN i > n - 24 AND i <= n - 12 THEN v ELSE 0 END) AS s2 FROM {src} GROUP BY k)",
    ]
    parts = {
        "naive": f"SELECT k, 'naive' AS model, h, last AS f FROM {p}_last, {p}_h",
        "mean": f"SELECT k, 'mean', h, avg FROM {p}_last, {p}_h",
        "snaive": f"SELECT l.k, 'snaive', h, x.v FROM {p}_last l, {p}_h, {src} x WHERE x.k = l.k AND x.i = l.n - 12 + (h - 1) % 12 + 1",
        "avg_factor": f"SELECT k, 'avg_factor', h, CASE WHEN s2 <> 0 THEN s1 / s2 ELSE 0 END * s1 / 12 FROM {p}_last, {p}_h",
        "monthly_mean": f"SELECT l.k, 'monthly_mean', h, AVG(x.v) FROM {p}_last l, {p}_h, {src} x WHERE x.k = l.k AND (x.i - 1) % 12 = (l.n + h - 1) % 12 GROUP BY 1, 3",
        "double": f"SELECT k, 'double', h, last + h * (last - prev) FROM {p}_last, {p}_h",
        "sarima": f"SELECT l.k, 'sarima', h, POW(LEAST(0.999, GREATEST(-0.999, phi)), h) * last FROM {p}_last l, {p}_h, {p}_phi q WHERE q.k = l.k",
        "SeasonalLinear": f"SELECT l.k, 'SeasonalLinear', h, (a + b * (l.n - 11 + h - 1)) * (SELECT AVG(q.ratio) FROM {p}_ratio q WHERE q.k = l.k AND (q.i - 1) % 12 = (l.n + h - 1) % 12) FROM {p}_last l, {p}_h, {p}_line y WHERE y.k = l.k",
        "SimpleExpSmoothing": f"SELECT k, 'SimpleExpSmoothing', h, level FROM {p}_ses, {p}_h",
        "ExponentialSmoothing": f"SELECT k, 'ExponentialSmoothing', h, level FROM {p}_ses, {p}_h",
        "holt": f"SELECT k, 'holt', h, level + h * trend FROM {p}_holt, {p}_h",
        "quadratic": f"SELECT k, 'quadratic', h, c0 + c1 * (n - 1 + h - mid) + c2 * (n - 1 + h - mid) * (n - 1 + h - mid) FROM {p}_quad, {p}_h",
    }
    if "sarima" in models:
        ctes.append(f"{p}_lag AS (SELECT k, v, LAG(v) OVER (PARTITION BY k ORDER BY i) AS pv FROM {src})")
        ctes.append(f"{p}_phi AS (SELECT k, SUM(v * pv) / SUM(pv * pv) AS phi FROM {p}_lag WHERE pv IS NOT NULL GROUP BY k)")
    if "SeasonalLinear" in models:
        ctes.append(f"{p}_roll AS (SELECT k, i, v, AVG(v) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS y FROM {src})")
        ctes.append(f"{p}_line AS (SELECT k, REGR_SLOPE(y, i - 12) AS b, REGR_INTERCEPT(y, i - 12) AS a FROM {p}_roll WHERE i >= 12 GROUP BY k)")
        ctes.append(f"{p}_ratio AS (SELECT x.k, x.i, x.v / (a + b * (x.i - 12)) AS ratio FROM {p}_roll x JOIN {p}_line y ON x.k = y.k)")
    if {"SimpleExpSmoothing", "ExponentialSmoothing"} & set(models):
        fold = "a.level + a.alpha * (x.v - a.level), a.sse + (x.v - a.level) * (x.v - a.level)"
        points = f"(SELECT DISTINCT k, alpha FROM {src}, (VALUES {alphas}) t(alpha))"
        for level in range(len(M.ALPHA_STEPS) + 1):
            ctes.append(f"""{p}_sesr{level} AS (SELECT x.k, g.alpha, x.i, x.n, x.v AS level, 0.0::DOUBLE AS sse FROM {src} x JOIN {points} g ON g.k = x.k WHERE x.i = 1
              UNION ALL SELECT a.k, a.alpha, x.i, x.n, {fold} FROM {p}_sesr{level} a JOIN {src} x ON x.k = a.k AND x.i = a.i + 1)""")
            name = f"{p}_ses" if level == len(M.ALPHA_STEPS) else f"{p}_ses{level}"
            ctes.append(f"{name} AS (SELECT k, MIN_BY(level, sse) AS level, MIN_BY(alpha, sse) AS alpha FROM {p}_sesr{level} WHERE i = n GROUP BY k)")
            if level < len(M.ALPHA_STEPS):
                around = ", ".join(f"(CAST({x} AS DOUBLE))" for x in M.ALPHA_STEPS[level])
                points = f"(SELECT DISTINCT k, LEAST(GREATEST(alpha + da, {M.LEAST_WEIGHT}), {M.MOST_WEIGHT}) AS alpha FROM {name}, (VALUES {around}) t(da))"
    if "holt" in models:
        ctes.append(f"{p}_two AS (SELECT k, MAX(CASE WHEN i = 1 THEN v END) AS v1, MAX(CASE WHEN i = 2 THEN v END) AS v2 FROM {src} GROUP BY k)")
        miss = "(x.v - a.level - a.phi * a.trend)"
        points = f"(SELECT DISTINCT k, alpha, beta, phi FROM {src}, (VALUES {grid}) t(alpha, beta, phi))"
        for level in range(len(steps_of) + 1):
            ctes.append(f"""{p}_holtr{level} AS (SELECT x.k, g.alpha, g.beta, g.phi, x.i, x.n, v1 AS level, v2 - v1 AS trend, 0.0::DOUBLE AS sse FROM {src} x JOIN {p}_two USING (k) JOIN {points} g ON g.k = x.k WHERE x.i = 1
              UNION ALL SELECT a.k, a.alpha, a.beta, a.phi, x.i, x.n, a.level + a.phi * a.trend + a.alpha * {miss}, a.phi * a.trend + a.alpha * a.beta * {miss}, a.sse + {miss} * {miss} FROM {p}_holtr{level} a JOIN {src} x ON x.k = a.k AND x.i = a.i + 1)""")
            name = f"{p}_holt" if level == len(steps_of) else f"{p}_holt{level}"
            ctes.append(f"{name} AS (SELECT k, {', '.join(f'MIN_BY({c}, sse) AS {c}' for c in ('level', 'trend', 'alpha', 'beta', 'phi'))} FROM {p}_holtr{level} WHERE i = n GROUP BY k)")
            if level < len(steps_of):
                around = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for a, b, c in steps_of[level])
                clip = lambda e, low, high: f"LEAST(GREATEST({e}, {low}), {high})"
                damping = clip("phi + dp", M.LEAST_PHI, M.MOST_PHI) if damped else "phi"
                points = (f"(SELECT DISTINCT k, {clip('alpha + da', M.LEAST_WEIGHT, M.MOST_WEIGHT)} AS alpha, {clip('beta * fb', M.LEAST_WEIGHT, M.MOST_WEIGHT)} AS beta, {damping} AS phi"
                          f" FROM {name}, (VALUES {around}) t(da, fb, dp))")
    if "quadratic" in models:
        ctes.append(f"{p}_u AS (SELECT k, n, (n - 1) / 2.0 AS mid, i - 1 - (n - 1) / 2.0 AS u, v FROM {src})")
        ctes.append(f"""{p}_quad AS (SELECT k, MAX(n) AS n, MAX(mid) AS mid, SUM(u * v) / SUM(u * u) AS c1,
          (COUNT(*) * SUM(u * u * v) - SUM(u * u) * SUM(v)) / (COUNT(*) * SUM(u * u * u * u) - SUM(u * u) * SUM(u * u)) AS c2,
          (SUM(v) - (COUNT(*) * SUM(u * u * v) - SUM(u * u) * SUM(v)) / (COUNT(*) * SUM(u * u * u * u) - SUM(u * u) * SUM(u * u)) * SUM(u * u)) / COUNT(*) AS c0 FROM {p}_u GROUP BY k)""")
    ctes.append(f"{p}_f(k, model, h, f) AS ({' UNION ALL '.join(parts[m] for m in models)})")
    return ",\n".join(ctes)


def model_sql(model: str) -> str:
    return f"""WITH RECURSIVE {R.BRAND}, {forecast_ctes('s', 'x', STEPS, [model])}, e AS (SELECT k, MAX(m) AS b FROM s GROUP BY k)
    SELECT x_f.k, h AS step, CAST(last_day(CAST(b + INTERVAL (h) MONTH AS DATE)) AS VARCHAR) AS month, {rs('f')} AS value FROM x_f JOIN e ON e.k = x_f.k"""


def shown(df):
    return df.select("k", big("step").alias("step"), txt("month").alias("month"), r("value").alias("value"))


def _model(name: str, label: str, model, sql_model: str):
    def run(spark, d):
        return shown(M.forecast(R.brand_arrays(spark, d), ["k"], model, STEPS))
    query(name, sql=model_sql(sql_model))(run)


_model("j01_naive", "naive", "naive", "naive")
_model("j02_seasonal_naive", "snaive", "snaive", "snaive")
_model("j03_mean", "mean", "mean", "mean")
_model("j04_calendar_month_mean", "monthly_mean", "monthly_mean", "monthly_mean")
_model("j05_average_factor", "avg_factor", "avg_factor", "avg_factor")
_model("j06_seasonal_linear", "SeasonalLinear", "SeasonalLinear", "SeasonalLinear")
_model("j07_exponential_smoothing", "SimpleExpSmoothing", "SimpleExpSmoothing", "SimpleExpSmoothing")
_model("j08_default_exponential_smoothing", "ExponentialSmoothing", "ExponentialSmoothing", "ExponentialSmoothing")
_model("j09_holt_trend", "holt", "holt", "holt")
_model("j12_autoregressive", "sarima", "sarima", "sarima")
_model("j13_double_difference", "double", M.double_difference, "double")
_model("j15_quadratic_trend", "quadratic", M.quadratic_trend, "quadratic")


def _damped_ctes() -> str:
    return forecast_ctes("s", "x", 12, ["holt"], tuple(D.DAMPING))


_SHRUNK = "CASE WHEN trend < 0 THEN trend * EXP(-{s} * ABS(trend) / (ABS(level) + 1e-6)) ELSE trend END"


@query("j10_damped_trend", sql=f"""
WITH RECURSIVE {R.BRAND}, {_damped_ctes()} SELECT k, h AS step, {rs(f"level + {_SHRUNK.format(s=3.0)} * (1 - POW(phi, h)) / (1 - phi)")} AS value FROM x_holt, x_h""")
def _(spark, d):
    path = A.let(D.damped_fit(F.col("values")), lambda f: D.damped_path(f, F.lit(3.0), 12))
    a = R.brand_arrays(spark, d).select("k", F.posexplode_outer(path).alias("_p", "v"))
    return a.select("k", big(F.col("_p") + 1).alias("step"), r("v").alias("value"))


_CREDIT = f"""{R.PAYMENTS}, bmx AS (SELECT huka, doc_type, last_day(payment_date) AS m, SUM(amount) AS v FROM payments GROUP BY 1, 2, 3),
spx AS (SELECT huka, doc_type, MIN(m) AS a, MAX(m) AS b FROM bmx GROUP BY 1, 2),
gx AS (SELECT huka, doc_type, last_day(CAST(g AS DATE)) AS m FROM spx, UNNEST(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) t(g)),
s AS (SELECT CAST(gx.huka AS VARCHAR) || gx.doc_type AS k, gx.m, COALESCE(bmx.v, 0) AS v, ROW_NUMBER() OVER (PARTITION BY gx.huka, gx.doc_type ORDER BY gx.m) AS i, COUNT(*) OVER (PARTITION BY gx.huka, gx.doc_type) AS n
  FROM gx LEFT JOIN bmx ON gx.huka = bmx.huka AND gx.doc_type = bmx.doc_type AND gx.m = bmx.m)"""
_SHRINKS = [2.0 + i for i in range(8)]


@query("j11_non_negative_search", sql=f"""
WITH RECURSIVE {_CREDIT}, {_damped_ctes()}, c AS (SELECT k, sh, h, level + (CASE WHEN trend < 0 THEN trend * EXP(-sh * ABS(trend) / (ABS(level) + 1e-6)) ELSE trend END) * (1 - POW(phi, h)) / (1 - phi) AS f
  FROM x_holt, x_h, (VALUES {', '.join(f'({x})' for x in _SHRINKS)}) t(sh)), t AS (SELECT k, sh, SUM(CASE WHEN h > 2 THEN f ELSE 0 END) AS tail, SUM(f) AS total FROM c GROUP BY 1, 2),
pick AS (SELECT k, COALESCE(MIN(CASE WHEN tail >= 0 THEN sh END), MAX(sh)) AS sh FROM t GROUP BY 1)
SELECT c.k, h AS step, {rs('CASE WHEN t.total < 0 THEN 0 ELSE f END')} AS value FROM c JOIN pick ON c.k = pick.k AND c.sh = pick.sh JOIN t ON t.k = c.k AND t.sh = c.sh""")
def _(spark, d):
    p = R.payments(spark, d).withColumn("k", F.concat(txt("huka"), "doc_type"))
    a = O.as_arrays(p, ["k"], "payment_date", "amount")
    path = D.non_negative_path(F.col("values"), 12, last_n=10, start=2.0, limit=10.0)
    return a.select("k", F.posexplode_outer(path).alias("_p", "v")).select("k", big(F.col("_p") + 1).alias("step"), r("v").alias("value"))


@query("j14_trend_order_search")
def _(spark, d):
    """Searched order and twelve months of the loess trend of every brand."""
    parts = D.stl(O.spread_series(R.brand_arrays(spark, d), ["k"]))
    found = D.trend_search(parts, "trend", 12)
    return found.select("k", "d", "p", F.posexplode_outer("trend_forecast").alias("_p", "v")).select(
        "k", big("d").alias("d"), big("p").alias("p"), big(F.col("_p") + 1).alias("step"), r("v").alias("value"))


@query("j14_level_test", sql=f"""
WITH {R.BRAND}, lv AS (SELECT k, 0 AS o, i, v AS y FROM s UNION ALL SELECT k, 1, i, y FROM (SELECT k, i, v - LAG(v) OVER (PARTITION BY k ORDER BY i) AS y FROM s) q WHERE y IS NOT NULL),
e AS (SELECT k, o, i, y - AVG(y) OVER (PARTITION BY k, o) AS e FROM lv), c AS (SELECT *, SUM(e) OVER (PARTITION BY k, o ORDER BY i) AS cs FROM e),
b AS (SELECT k, o, COUNT(*) AS n, SUM(cs * cs) AS partial, SUM(e * e) AS own, floor(sqrt(COUNT(*)) * 3 / 13) AS lags FROM c GROUP BY 1, 2),
g AS (SELECT x.k, x.o, SUM((1 - (x.i - z.i) / (lags + 1.0)) * x.e * z.e) AS covar FROM e x JOIN e z ON x.k = z.k AND x.o = z.o AND x.i > z.i JOIN b ON b.k = x.k AND b.o = x.o WHERE x.i - z.i <= lags GROUP BY 1, 2),
st AS (SELECT b.k, b.o, partial / (n * (own + 2 * COALESCE(covar, 0))) AS stat FROM b LEFT JOIN g ON b.k = g.k AND b.o = g.o)
SELECT k, {rs('MAX(CASE WHEN o = 0 THEN stat END)', 6)} AS plain, {rs('MAX(CASE WHEN o = 1 THEN stat END)', 6)} AS differenced,
 CAST(CASE WHEN MAX(CASE WHEN o = 0 THEN stat END) <= {G.KPSS_LIMIT} THEN 0 WHEN MAX(CASE WHEN o = 1 THEN stat END) <= {G.KPSS_LIMIT} THEN 1 ELSE 2 END AS BIGINT) AS d FROM st GROUP BY 1""")
def _(spark, d):
    """Statistic of the level test of every brand, plain and differenced, and the order of differencing it asks for."""
    a = R.brand_arrays(spark, d)
    x = A.computed_once(a, plain=G.kpss(F.col("values")), differenced=G.kpss(G.difference(F.col("values"))), d=G.differences_needed(F.col("values")))
    return x.select("k", r("plain", 6).alias("plain"), r("differenced", 6).alias("differenced"), big("d").alias("d"))


@query("j16_zero_for_empty_history", sql=f"""
WITH {R.BRAND}, w AS (SELECT k, i, v, (SELECT AVG(top) FROM (SELECT MAX(v) AS top FROM s GROUP BY k) q) AS strong FROM s), c AS (SELECT k, COUNT(CASE WHEN v > strong THEN 1 END) AS months, MAX_BY(v, i) FILTER (WHERE v > strong) AS last FROM w GROUP BY 1)
SELECT k, CAST(h AS BIGINT) AS step, months, {rs('COALESCE(last, 0)')} AS value FROM c, generate_series(1, 3) t(h)""")
def _(spark, d):
    # only months over the mean of the brands' best months count as history here, so some brands have none
    arrays = R.brand_arrays(spark, d)
    strong = arrays.agg(F.avg(F.array_max("values"))).first()[0]
    a = arrays.withColumn("values", F.filter("values", lambda v: v > strong)).withColumn("months", F.size("values"))
    return M.forecast(a, ["k"], "naive", 3, ["months"]).select("k", big("step").alias("step"), big("months").alias("months"), r("value").alias("value"))


@query("j17_sparse_fallback", sql=f"""
WITH {R.PAYMENTS}, y AS (SELECT huka, fc3, payment_year, SUM(amount) AS v FROM payments GROUP BY 1, 2, 3), sp AS (SELECT huka, fc3, MIN(payment_year) AS a, MAX(payment_year) AS b FROM payments GROUP BY 1, 2),
g AS (SELECT huka, fc3, CAST(t AS INT) AS payment_year FROM sp, UNNEST(generate_series(a, b)) u(t)), f AS (SELECT huka, fc3, AVG(COALESCE(v, 0)) AS v FROM g LEFT JOIN y USING (huka, fc3, payment_year) WHERE payment_year BETWEEN 2000 AND 2002 GROUP BY 1, 2)
SELECT CAST(huka AS BIGINT) AS huka, CAST(fc3 AS BIGINT) AS fc3, CAST(mo AS BIGINT) AS month_no, {rs('v / 12', 3)} AS value FROM f, generate_series(1, 12) t(mo)""")
def _(spark, d):
    x = D.sparse_mean(R.payments(spark, d), ["huka", "fc3"], "payment_date", "amount", 2002)
    return x.select(big("huka").alias("huka"), big("fc3").alias("fc3"), big("month_no").alias("month_no"), r("value", 3).alias("value"))


def _classical_ctes(value: str) -> str:
    return f"""t0 AS (SELECT k, m, i, n, {value} AS v FROM s),
t1 AS (SELECT *, CASE WHEN i > 6 AND i <= n - 6 THEN (SUM(v) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (LAG(v, 6) OVER (PARTITION BY k ORDER BY m) + LEAD(v, 6) OVER (PARTITION BY k ORDER BY m)) / 2) / 12 END AS trend FROM t0),
mm AS (SELECT k, MONTH(m) AS mo, AVG(v - trend) AS sm FROM t1 GROUP BY 1, 2), cc AS (SELECT k, AVG(sm) AS c FROM mm GROUP BY 1),
parts AS (SELECT t1.*, sm - c AS seasonal, v - trend - (sm - c) AS resid FROM t1 JOIN mm ON mm.k = t1.k AND mm.mo = MONTH(t1.m) JOIN cc ON cc.k = t1.k)"""


def _classical(spark, d, kind="additive"):
    return D.classical(R.brand_months(spark, d), ["k"], "m", "v", kind)


def _components(name, kind, value, digits):
    def run(spark, d):
        x = _classical(spark, d, kind).where(F.col("trend").isNotNull())
        return x.select("k", txt("m").alias("m"), *[r(c, digits).alias(c) for c in ("trend", "seasonal", "resid")])
    sql = f"""WITH {R.BRAND}, {_classical_ctes(value)} SELECT k, CAST(m AS VARCHAR) AS m, {rs('trend', digits)} AS trend, {rs('seasonal', digits)} AS seasonal, {rs('resid', digits)} AS resid FROM parts WHERE trend IS NOT NULL"""
    query(name, sql=sql)(run)


_components("j18_classical_decomposition", "additive", "v", 3)
_components("j19_log_decomposition", "multiplicative", "LN(1 + v)", 7)


@query("j18_loess_decomposition")
def _(spark, d):
    """Robust loess components of every brand month; they add up to the value."""
    a = D.stl(O.spread_series(R.brand_arrays(spark, d), ["k"]))
    z = F.arrays_zip(O.month_range("first_month", "last_month").alias("m"), "values", "trend", "seasonal", "resid")
    return a.select("k", F.explode_outer(z).alias("z")).select("k", txt("z.m").alias("m"), *[r(f"z.{c}", 3).alias(c) for c in ("values", "trend", "seasonal", "resid")])


@query("j18_loess_adds_up", sql=f"WITH {R.BRAND} SELECT k, CAST(m AS VARCHAR) AS m, {rs('v')} AS value FROM s")
def _(spark, d):
    """Trend, season and rest of the loess decomposition added up, beside the series itself in SQL."""
    a = D.stl(O.spread_series(R.brand_arrays(spark, d), ["k"]))
    z = F.arrays_zip(O.month_range("first_month", "last_month").alias("m"), "trend", "seasonal", "resid")
    rows = a.select("k", F.explode_outer(z).alias("z"))
    return rows.select("k", txt("z.m").alias("m"), r(F.col("z.trend") + F.col("z.seasonal") + F.col("z.resid")).alias("value"))


@query("j20_decomposition_choice", sql=f"""
WITH {R.BRAND}, w AS (SELECT k, m, v, AVG(v) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS trend, STDDEV_SAMP(v) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS sd, i FROM s),
g AS (SELECT k, REGR_SLOPE(sd, trend) AS slope, REGR_R2(sd, trend) AS r2, REGR_SLOPE(sd, trend) * AVG(trend) / AVG(sd) AS el FROM w WHERE i >= 2 GROUP BY 1)
SELECT k, {rs('slope', 6)} AS slope, {rs('r2', 6)} AS r2, {rs('el', 6)} AS elasticity, CASE WHEN r2 > 0.5 AND el > 0.1 THEN 'multiplicative' ELSE 'additive' END AS decomposition FROM g""")
def _(spark, d):
    months = R.brand_months(spark, d)
    both = windows.rolling_std(windows.centered_mean(months, ["k"], ["m"], "v"), ["k"], ["m"], "v")
    negative = months.groupBy("k").agg((F.min("v") < 0).alias("has_negative"))
    x = D.decomposition_type(D.variance_diagnostics(both, ["k"]).join(negative, "k"))
    return x.select("k", *[r(c, 6).alias(c) for c in ("slope", "r2", "elasticity")], "decomposition")


TILED = f"""{R.BRAND}, {_classical_ctes('v')}, til AS (SELECT p.k, h, p.seasonal FROM parts p, generate_series(1, 14) t(h) WHERE p.i = p.n - 12 + (h - 1) % 12 + 1)"""


def _seasonal_arrays(spark, d):
    x = _classical(spark, d)
    return x.groupBy("k").agg(F.max("m").alias("last_month"), F.transform(F.array_sort(F.collect_list(F.struct("m", "seasonal"))), lambda s: s["seasonal"]).alias("seasonal"))


@query("j21_tiled_season", sql=f"WITH {TILED} SELECT k, CAST(h AS BIGINT) AS step, {rs('seasonal', 3)} AS value FROM til")
def _(spark, d):
    a = _seasonal_arrays(spark, d).select("k", F.posexplode(D.tile_season(F.col("seasonal"), 14)).alias("_p", "v"))
    return a.select("k", big(F.col("_p") + 1).alias("step"), r("v", 3).alias("value"))


def _trend_and_season(spark, d):
    a = R.brand_arrays(spark, d).join(_seasonal_arrays(spark, d).select("k", "seasonal"), "k")
    total = D.zero_if_negative(D.combine(M.quadratic_trend(F.col("values"), 14), D.tile_season(F.col("seasonal"), 14)))
    return M.explode_steps(a.withColumn("_f", total), ["k"], "_f")


COMBINED = f"""{TILED}, {forecast_ctes('s', 'x', 14, ['quadratic'])}, e AS (SELECT k, MAX(m) AS b FROM s GROUP BY k),
cf AS (SELECT til.k, til.h, last_day(CAST(b + INTERVAL (til.h) MONTH AS DATE)) AS m, CASE WHEN SUM(f + seasonal) OVER (PARTITION BY til.k) < 0 THEN 0 ELSE f + seasonal END AS v FROM til JOIN x_f ON x_f.k = til.k AND x_f.h = til.h JOIN e ON e.k = til.k)"""


@query("j22_trend_plus_season", sql=f"WITH {COMBINED} SELECT k, CAST(m AS VARCHAR) AS month, {rs('v')} AS value FROM cf WHERE YEAR(m) = 2002")
def _(spark, d):
    x = _trend_and_season(spark, d).where(F.year("month") == 2002)
    return x.select("k", txt("month").alias("month"), r("value").alias("value"))


@query("j22_replace_negative_total", sql=f"""
WITH {R.PAYMENTS}, t AS (SELECT huka, doc_type, SUM(CASE WHEN payment_year = 2000 THEN amount ELSE 0 END) AS p, SUM(CASE WHEN payment_year = 2001 THEN amount ELSE 0 END) AS l FROM payments GROUP BY 1, 2)
SELECT CAST(huka AS BIGINT) AS huka, doc_type, {rs('CASE WHEN 2 * l - p < 0 THEN l ELSE 2 * l - p END')} AS value FROM t""")
def _(spark, d):
    def year(y):
        return F.sum(F.when(F.col("payment_year") == y, F.col("amount")).otherwise(0.0))
    t = R.payments(spark, d).groupBy("huka", "doc_type").agg(year(2000).alias("p"), year(2001).alias("l"))
    value = D.replace_negative(F.col("l") * 2 - F.col("p"), F.col("l"))
    return t.select(big("huka").alias("huka"), "doc_type", r(value).alias("value"))


@query("j23_monthly_bounds", sql=f"""
WITH {COMBINED}, sd AS (SELECT k, STDDEV_SAMP(resid) AS sd FROM parts GROUP BY 1) SELECT cf.k, CAST(m AS VARCHAR) AS month, {rs('v')} AS value, {rs('v - 0.95 * sd')} AS lower, {rs('v + 0.95 * sd')} AS upper FROM cf JOIN sd ON sd.k = cf.k""")
def _(spark, d):
    x = D.bounds(_classical(spark, d), ["k"], "m", _trend_and_season(spark, d))
    return x.select("k", txt("month").alias("month"), r("value").alias("value"), r("lower").alias("lower"), r("upper").alias("upper"))


@query("j23_yearly_bounds", sql=f"""
WITH {COMBINED}, ry AS (SELECT k, YEAR(m) AS y, SUM(resid) AS rr FROM parts WHERE resid IS NOT NULL GROUP BY 1, 2), sd AS (SELECT k, STDDEV_SAMP(rr) AS sd FROM ry GROUP BY 1), cy AS (SELECT k, YEAR(m) AS y, SUM(v) AS v FROM cf GROUP BY 1, 2)
SELECT cy.k, CAST(y AS BIGINT) AS year, {rs('v')} AS value, {rs('v - 0.95 * sd')} AS lower, {rs('v + 0.95 * sd')} AS upper FROM cy JOIN sd ON sd.k = cy.k""")
def _(spark, d):
    x = D.yearly_bounds(_classical(spark, d), ["k"], "m", _trend_and_season(spark, d))
    return x.select("k", big("year").alias("year"), r("value").alias("value"), r("lower").alias("lower"), r("upper").alias("upper"))


@query("j24_quiet_or_damped", sql=f"""
WITH RECURSIVE {_CREDIT}, {forecast_ctes('s', 'y', 12, ['double'])}, {_damped_ctes()},
st AS (SELECT k, MIN(v) AS low, SUM(CASE WHEN YEAR(m) IN (2000, 2001) THEN v ELSE 0 END) AS recent FROM s GROUP BY 1), lo AS (SELECT k, MIN(f) AS flow FROM y_f GROUP BY 1)
SELECT y_f.k, y_f.h AS step, {rs(f"CASE WHEN recent = 0 THEN 0 WHEN flow < 0 AND low >= 0 THEN level + {_SHRUNK.format(s=3.0)} * (1 - POW(phi, y_f.h)) / (1 - phi) ELSE f END")} AS value
FROM y_f JOIN st ON st.k = y_f.k JOIN lo ON lo.k = y_f.k JOIN x_holt ON x_holt.k = y_f.k""")
def _(spark, d):
    p = R.payments(spark, d).withColumn("k", F.concat(txt("huka"), "doc_type"))
    a = O.as_arrays(p, ["k"], "payment_date", "amount")
    recent = p.where(F.col("payment_year").isin(2000, 2001)).groupBy("k").agg(F.sum("amount").alias("recent"))
    a = a.join(recent, "k", "left").withColumn("recent", F.coalesce("recent", F.lit(0.0)))
    path = D.quiet_or_damped(M.double_difference(F.col("values"), 12), F.col("values"), F.col("recent"), 12)
    return a.select("k", F.posexplode_outer(path).alias("_p", "v")).select("k", big(F.col("_p") + 1).alias("step"), r("v").alias("value"))


_KINDS = """w0 AS (SELECT k, m, v, AVG(v) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS trend, STDDEV_SAMP(v) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS sd, i FROM s0),
kinds AS (SELECT k, CASE WHEN MIN(v) < 0 THEN 'additive' WHEN REGR_R2(sd, trend) FILTER (WHERE i >= 2) > 0.5 AND (REGR_SLOPE(sd, trend) FILTER (WHERE i >= 2)) * (AVG(trend) FILTER (WHERE i >= 2)) / (AVG(sd) FILTER (WHERE i >= 2)) > 0.1 THEN 'multiplicative' ELSE 'additive' END AS kind FROM w0 GROUP BY 1),
s AS (SELECT s0.k, m, CASE WHEN kind = 'multiplicative' THEN LN(1 + v) ELSE v END AS v, i, n FROM s0 JOIN kinds USING (k))"""
ANALYSED_YEAR = 2001
_AHEAD = 2 + 6  # November and December, and the half year without a known trend
ANALYSED = f"""{R.ACCOUNTS}, {_KINDS}, {_classical_ctes('v')}, tt AS (SELECT k, m, trend AS v, i - 6 AS i, n - 12 AS n FROM parts WHERE trend IS NOT NULL),
{forecast_ctes('tt', 'q', _AHEAD, ['quadratic'])}, {forecast_ctes('tt', 'x', _AHEAD, ['holt'], tuple(D.DAMPING))},
facts AS (SELECT k, MAX(n) AS n, MAX(m) AS last, STDDEV_SAMP(resid) AS msd, SUM(CASE WHEN YEAR(m) IN ({ANALYSED_YEAR - 2}, {ANALYSED_YEAR - 1}) THEN COALESCE(trend, 0) END) AS recent, MIN(trend) AS low FROM parts GROUP BY 1),
ysd AS (SELECT k, STDDEV_SAMP(r) AS ysd FROM (SELECT k, YEAR(m) AS y, SUM(resid) AS r FROM parts WHERE resid IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
falls AS (SELECT k, MIN(f) AS least FROM q_f GROUP BY 1),
ahead AS (SELECT q_f.k, facts.n - 6 + q_f.h AS i, CASE WHEN recent = 0 THEN 0 WHEN least < 0 AND low >= 0 THEN level + {_SHRUNK.format(s=3.0)} * (1 - POW(phi, q_f.h)) / (1 - phi) ELSE f END AS t
  FROM q_f JOIN facts ON facts.k = q_f.k JOIN falls ON falls.k = q_f.k JOIN x_holt ON x_holt.k = q_f.k),
trends AS (SELECT k, i, trend AS t FROM parts WHERE trend IS NOT NULL UNION ALL SELECT * FROM ahead),
seasons AS (SELECT k, i, seasonal FROM parts UNION ALL SELECT p.k, p.n + h, p.seasonal FROM parts p, generate_series(1, 2) t(h) WHERE p.i = p.n - 12 + h),
dated AS (SELECT k, kind, last_day(CAST(last + INTERVAL (i - n) MONTH AS DATE)) AS m, t + seasonal AS v, msd, ysd FROM trends JOIN seasons USING (k, i) JOIN facts USING (k) JOIN ysd USING (k) JOIN kinds USING (k)),
back AS (SELECT k, kind, m, ysd, {', '.join(f"CASE WHEN kind = 'multiplicative' THEN EXP({e}) - 1 ELSE {e} END AS {n}" for n, e in (('value', 'v'), ('lower', 'v - 0.95 * msd'), ('upper', 'v + 0.95 * msd'), ('ylow', 'v - 0.95 * ysd'), ('yhigh', 'v + 0.95 * ysd')))}
  FROM dated WHERE YEAR(m) = {ANALYSED_YEAR})"""


def _analysed(spark, d):
    return analysis.run(R.accounts(spark, d), ["k"], "date", "amount", R.CLOSED_TO, ANALYSED_YEAR)


@query("j24_analysis_by_month", sql=f"""
WITH RECURSIVE {ANALYSED} SELECT k, kind AS decomposition, CAST(m AS VARCHAR) AS month, {rs('value')} AS value, {rs('lower')} AS lower, {rs('upper')} AS upper FROM back""")
def _(spark, d):
    """Kind, components, trend, season and bounds of every account in one run, some in logs and some not."""
    x = _analysed(spark, d)[0]
    return x.select("k", "decomposition", txt("month").alias("month"), r("value").alias("value"), r("lower").alias("lower"), r("upper").alias("upper"))


@query("j24_analysis_by_year", sql=f"""
WITH RECURSIVE {ANALYSED}, y AS (SELECT k, kind, SUM(value) AS value, SUM(ylow) AS ylow, SUM(yhigh) AS yhigh, MAX(ysd) AS ysd FROM back GROUP BY 1, 2)
SELECT k, kind AS decomposition, {rs('value')} AS value, {rs("CASE WHEN kind = 'multiplicative' THEN ylow ELSE value - 0.95 * ysd END")} AS lower, {rs("CASE WHEN kind = 'multiplicative' THEN yhigh ELSE value + 0.95 * ysd END")} AS upper FROM y""")
def _(spark, d):
    x = _analysed(spark, d)[1]
    return x.select("k", "decomposition", r("value").alias("value"), r("lower").alias("lower"), r("upper").alias("upper"))


RANKED = f"""{R.BRAND}, lv AS (SELECT k, MONTH(m) AS mo, FLOOR(v / 200000) AS v FROM s), rk AS (SELECT k, mo, v, RANK() OVER (PARTITION BY k ORDER BY v) + (COUNT(*) OVER (PARTITION BY k, v) - 1) / 2.0 AS rk, COUNT(*) OVER (PARTITION BY k) AS n FROM lv),
ti AS (SELECT k, SUM(c * c * c - c) AS t FROM (SELECT k, v, COUNT(*) AS c FROM lv GROUP BY 1, 2) q GROUP BY 1), gm AS (SELECT k, mo, MAX(n) AS n, COUNT(*) AS c, SUM(rk) AS rsum FROM rk GROUP BY 1, 2)"""


def _levels(spark, d):
    return R.brand_months(spark, d).withColumn("v", F.floor(F.col("v") / 200000))


@query("j25_kruskal_wallis", sql=f"""
WITH {RANKED}, hh AS (SELECT k, 12.0 / (MAX(n) * (MAX(n) + 1.0)) * SUM(rsum * rsum / c) - 3.0 * (MAX(n) + 1) AS h0, MAX(n) AS n, COUNT(*) - 1 AS df FROM gm GROUP BY 1)
SELECT hh.k, CAST(df AS BIGINT) AS df, {rs('h0 / (1 - t / (CAST(n AS DOUBLE) * n * n - n))', 5)} AS h FROM hh JOIN ti ON ti.k = hh.k""")
def _(spark, d):
    x = G.kruskal_by_month(_levels(spark, d), ["k"], "m", "v")
    return x.select("k", big("df").alias("df"), r("h", 5).alias("h"))


@query("j25_kruskal_p_values")
def _(spark, d):
    return G.kruskal_by_month(_levels(spark, d), ["k"], "m", "v").select("k", r("h", 5).alias("h"), r("p", 8).alias("p"))


@query("j26_dunn_pairs", sql=f"""
WITH {RANKED} SELECT a.k, CAST(a.mo AS BIGINT) AS month_a, CAST(b.mo AS BIGINT) AS month_b, {rs('(a.rsum / a.c - b.rsum / b.c) / SQRT((a.n * (a.n + 1.0) / 12.0 - t / (12.0 * (a.n - 1))) * (1.0 / a.c + 1.0 / b.c))', 6)} AS z
FROM gm a JOIN gm b ON a.k = b.k AND a.mo < b.mo JOIN ti ON ti.k = a.k""")
def _(spark, d):
    x = G.dunn_by_month(_levels(spark, d), ["k"], "m", "v")
    return x.select("k", big("month_a").alias("month_a"), big("month_b").alias("month_b"), r("z", 6).alias("z"))


@query("j27_yearly_std_from_months", sql=f"""
WITH {R.BRAND}, x AS (SELECT k, MONTH(m) AS mo, VAR_SAMP(v) AS vv FROM s GROUP BY 1, 2) SELECT k, {rs('SQRT(SUM(vv))')} AS yearly_std FROM x GROUP BY 1""")
def _(spark, d):
    return G.yearly_std_from_months(R.brand_months(spark, d), ["k"], "m", "v").select("k", r("yearly_std").alias("yearly_std"))


@query("j28_autocorrelation", sql=f"""
WITH {R.BRAND}, c AS (SELECT k, i, n, v - AVG(v) OVER (PARTITION BY k) AS c FROM s), q AS (SELECT k, SUM(c * c) AS sq FROM c GROUP BY 1)
SELECT a.k, CAST(a.i - b.i AS BIGINT) AS lag, {rs('SUM(a.c * b.c) / MAX(sq)', 7)} AS acf FROM c a JOIN c b ON a.k = b.k AND a.i - b.i BETWEEN 1 AND 48 JOIN q ON q.k = a.k GROUP BY 1, 2""")
def _(spark, d):
    x = G.autocorrelation(R.brand_months(spark, d), ["k"], "m", "v")
    return x.select("k", big("lag").alias("lag"), r("acf", 7).alias("acf"))
