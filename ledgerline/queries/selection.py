"""Model scoring, selection and the quarterly runs."""

from pyspark.sql import functions as F

from ..forecast import models as M
from ..forecast import select as S
from ..operators import series as O
from ..plans import quarterly
from . import query
from . import roles as R
from .cleaning import kept_budget
from .joining import PAIRS
from .models import forecast_ctes
from .roles import big, r, rs, txt

ALL = list(M.REGISTRY)
_RANK = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(ALL)) + " END"


def scored_ctes(models: list[str], rank: str = _RANK) -> str:
    return f"""tr AS (SELECT k, m, v, i, n - 12 AS n FROM s WHERE i <= n - 12), {forecast_ctes('tr', 'x', 12, models)},
cmp AS (SELECT x_f.k, model, YEAR(s.m) AS y, SUM(s.v) AS a, SUM(f) AS f FROM x_f JOIN s ON s.k = x_f.k AND s.i = s.n - 12 + h GROUP BY 1, 2, 3),
sc AS (SELECT k, model, AVG(ABS(a - f) / NULLIF(ABS(a), 0)) AS score FROM cmp GROUP BY 1, 2),
win AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY score, {rank}) AS rn FROM sc) q WHERE rn = 1)"""


@query("k01_holdout_scores", sql=f"WITH RECURSIVE {R.BRAND}, {scored_ctes(ALL)} SELECT k, model, {rs('score', 7)} AS score FROM sc")
def _(spark, d):
    scored = S.score_models(R.brand_arrays(spark, d), ["k"], ALL)
    return S.score_table(scored, ["k"]).select("k", "model", r("score", 7).alias("score"))


@query("k02_winning_models", sql=f"WITH RECURSIVE {R.BRAND}, {scored_ctes(ALL)} SELECT k, model, {rs('score', 7)} AS score FROM win")
def _(spark, d):
    chosen = S.choose(S.score_models(R.brand_arrays(spark, d), ["k"], ALL))
    return S.winners(chosen, ["k"]).select("k", "model", r("score", 7).alias("score"))


@query("k02_highest_score_option", sql=f"""
WITH RECURSIVE {R.BRAND}, {scored_ctes(ALL)} SELECT k, model, {rs('score', 7)} AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY score DESC, {_RANK}) AS rm FROM sc) q WHERE rm = 1""")
def _(spark, d):
    chosen = S.choose(S.score_models(R.brand_arrays(spark, d), ["k"], ALL), "max")
    return S.winners(chosen, ["k"]).select("k", "model", r("score", 7).alias("score"))


@query("k03_forecast_with_winner", sql=f"""
WITH RECURSIVE {R.BRAND}, {scored_ctes(ALL)}, {forecast_ctes('s', 'z', 12, ALL)}, e AS (SELECT k, MAX(m) AS b FROM s GROUP BY k)
SELECT win.k, win.model, z_f.h AS step, CAST(last_day(CAST(b + INTERVAL (z_f.h) MONTH AS DATE)) AS VARCHAR) AS month, {rs('z_f.f')} AS value FROM win JOIN z_f ON z_f.k = win.k AND z_f.model = win.model JOIN e ON e.k = win.k""")
def _(spark, d):
    x = S.quarterly_run(R.brand_arrays(spark, d), ["k"], 12, ALL)
    return x.select("k", "model", big("step").alias("step"), txt("month").alias("month"), r("value").alias("value"))


@query("k03_past_year_without_leak", sql=f"""
WITH {R.BRAND.replace("s AS (SELECT grid.k", "s0 AS (SELECT grid.k")}, s AS (SELECT k, m, v, i, COUNT(*) OVER (PARTITION BY k) AS n FROM s0 WHERE YEAR(m) < 2000), tr AS (SELECT k, m, v, i, n - 12 AS n FROM s WHERE i <= n - 12),
{forecast_ctes('tr', 'x', 12, ['naive', 'snaive', 'mean'])}, cmp AS (SELECT x_f.k, model, SUM(s.v) AS a, SUM(f) AS f FROM x_f JOIN s ON s.k = x_f.k AND s.i = s.n - 12 + h GROUP BY 1, 2),
win AS (SELECT k, MIN_BY(model, ABS(a - f) / a) AS model FROM cmp GROUP BY 1), {forecast_ctes('s', 'z', 12, ['naive', 'snaive', 'mean'])}
SELECT win.k, win.model, {rs('SUM(z_f.f)')} AS value FROM win JOIN z_f ON z_f.k = win.k AND z_f.model = win.model GROUP BY 1, 2""")
def _(spark, d):
    a = S.cut_at_year(R.brand_arrays(spark, d), 2000)
    x = S.quarterly_run(a, ["k"], 12, ["naive", "snaive", "mean"])
    return x.groupBy("k", "model").agg(r(F.sum("value")).alias("value"))


@query("k03_recent_months_only", sql=f"""
WITH {R.BRAND}, sm AS (SELECT k, AVG(v) AS v FROM s WHERE i > n - 36 GROUP BY 1) SELECT k, {rs('v', 3)} AS value FROM sm""")
def _(spark, d):
    a = S.last_months(R.brand_arrays(spark, d), 36)
    return M.forecast(a, ["k"], "mean", 1).select("k", r("value", 3).alias("value"))


@query("k04_winner_counts", sql=f"WITH RECURSIVE {R.BRAND}, {scored_ctes(ALL)} SELECT model, CAST(COUNT(*) AS BIGINT) AS series FROM win GROUP BY 1")
def _(spark, d):
    chosen = S.choose(S.score_models(R.brand_arrays(spark, d), ["k"], ALL))
    return S.winners(chosen, ["k"]).groupBy("model").agg(F.count("*").alias("series"))


TOPIC_SETS = {"career_salary": ["mean", "naive"], "rest": ["snaive", "holt", "SeasonalLinear", "monthly_mean"], "vehicles": M.PAIR_MODELS}
TOPIC_SERIES = f"""{kept_budget(1)}, tm AS (SELECT type || '|' || fingroup AS k, type, last_day(make_date(financial_year, month_no, 1)) AS m, SUM(volume) AS v FROM kept GROUP BY 1, 2, 3),
tb AS (SELECT type || '|' || fingroup AS k, MIN(type) AS type, MIN(financial_year) AS a, MAX(financial_year) AS z FROM kept GROUP BY 1),
tg AS (SELECT k, type, last_day(CAST(t AS DATE)) AS m FROM tb, UNNEST(generate_series(CAST(make_date(a, 1, 1) AS TIMESTAMP), CAST(make_date(z, 12, 1) AS TIMESTAMP), INTERVAL 1 MONTH)) u(t)),
s AS (SELECT tg.k, tg.m, COALESCE(tm.v, 0) AS v, ROW_NUMBER() OVER (PARTITION BY tg.k ORDER BY tg.m) AS i, COUNT(*) OVER (PARTITION BY tg.k) AS n FROM tg LEFT JOIN tm ON tm.k = tg.k AND tm.m = tg.m)"""
_SETS = ", ".join(f"('{t}', '{m}', {i})" for t, models in TOPIC_SETS.items() for i, m in enumerate(models))
_DEFAULT = ", ".join(f"('{m}', {i})" for i, m in enumerate(M.DEFAULT_MODELS))
TOPIC_CHOICE = f"""own(type, model, rank) AS (VALUES {_SETS}), usual(model, rank) AS (VALUES {_DEFAULT}),
allowed AS (SELECT k, model, rank FROM tb JOIN own USING (type) UNION ALL SELECT k, model, rank FROM tb, usual WHERE type NOT IN (SELECT type FROM own)),
tr AS (SELECT k, m, v, i, n - 12 AS n FROM s WHERE i <= n - 12 AND n >= 24), {forecast_ctes('tr', 'x', 12, ALL)},
cmp AS (SELECT x_f.k, model, YEAR(s.m) AS y, SUM(s.v) AS a, SUM(f) AS f FROM x_f JOIN s ON s.k = x_f.k AND s.i = s.n - 12 + h GROUP BY 1, 2, 3),
sc AS (SELECT k, model, AVG(ABS(a - f) / NULLIF(ABS(a), 0)) AS score FROM cmp GROUP BY 1, 2),
win AS (SELECT * FROM (SELECT sc.*, ROW_NUMBER() OVER (PARTITION BY k ORDER BY score, rank) AS rn FROM sc JOIN allowed USING (k, model) WHERE score IS NOT NULL) q WHERE rn = 1)"""


@query("k05_topic_forecast", sql=f"""
WITH RECURSIVE {TOPIC_SERIES}, {TOPIC_CHOICE}, {forecast_ctes('s', 'z', 6, ALL)}, e AS (SELECT k, MAX(m) AS b FROM s GROUP BY k)
SELECT SPLIT_PART(tb.k, '|', 1) AS type, SPLIT_PART(tb.k, '|', 2) AS fingroup, win.model, CAST(z_f.h AS BIGINT) AS step,
 CASE WHEN win.k IS NOT NULL THEN CAST(last_day(CAST(b + INTERVAL (z_f.h) MONTH AS DATE)) AS VARCHAR) END AS month, CASE WHEN win.k IS NOT NULL THEN {rs('COALESCE(z_f.f, 0)')} END AS value
FROM tb LEFT JOIN win ON win.k = tb.k LEFT JOIN z_f ON z_f.k = win.k AND z_f.model = win.model JOIN e ON e.k = tb.k""")
def _(spark, d):
    """Labelled budget rows forecast per (type, group), each by the best model of its type's set; series without one stay as a row."""
    rows = quarterly.labelled(quarterly.budget_long(R.budget_wide(spark, d)), 1)
    x = quarterly.forecast_types(quarterly.type_series(rows), 6, quarterly.model_sets(spark, TOPIC_SETS))
    return x.select("type", "fingroup", "model", big("step").alias("step"), txt("month").alias("month"), r("value").alias("value"))


_PAIR = PAIRS + """, pm AS (SELECT class_out || '>' || class_in AS k, last_day(make_date(year, month, 1)) AS m, SUM(value) AS v FROM pairs GROUP BY 1, 2), pb AS (SELECT MIN(m) AS a, MAX(m) AS z FROM pm), pk AS (SELECT DISTINCT k FROM pm),
pgd AS (SELECT k, last_day(CAST(t AS DATE)) AS m FROM pk, pb, UNNEST(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH)) u(t)),
s AS (SELECT pgd.k, pgd.m, COALESCE(pm.v, 0) AS v, ROW_NUMBER() OVER (PARTITION BY pgd.k ORDER BY pgd.m) AS i, COUNT(*) OVER (PARTITION BY pgd.k) AS n FROM pgd LEFT JOIN pm ON pm.k = pgd.k AND pm.m = pgd.m)"""
_PAIR_RANK = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(M.PAIR_MODELS)) + " END"


@query("k05_net_pair_forecast", sql=f"""
WITH RECURSIVE {_PAIR}, {scored_ctes(M.PAIR_MODELS, _PAIR_RANK)}, {forecast_ctes('s', 'z', 3, M.PAIR_MODELS)}, e AS (SELECT k, MAX(m) AS b FROM s GROUP BY k),
fc AS (SELECT SPLIT_PART(win.k, '>', 1) AS co, SPLIT_PART(win.k, '>', 2) AS ci, CAST(last_day(CAST(b + INTERVAL (z_f.h) MONTH AS DATE)) AS VARCHAR) AS month, z_f.f FROM win JOIN z_f ON z_f.k = win.k AND z_f.model = win.model JOIN e ON e.k = win.k)
SELECT 'out' AS side, co AS party, month, {rs('SUM(f)')} AS net FROM fc GROUP BY 2, 3 UNION ALL SELECT 'in', ci, month, {rs('-SUM(f)')} FROM fc GROUP BY 2, 3""")
def _(spark, d):
    months = quarterly.pair_series(quarterly.change_pairs(R.change_lines(spark, d)))
    net = quarterly.net_forecast(quarterly.forecast_pairs(months, 3))
    return net.select("side", "party", txt("month").alias("month"), r("net").alias("net"))


@query("k03_every_series_once", sql=f"""
WITH {R.BRAND}, last AS (SELECT k, MAX(n) AS n, MAX(m) AS z, SUM(CASE WHEN i > n - 24 THEN v ELSE 0 END) AS late FROM s GROUP BY 1)
SELECT k, CASE WHEN n < 24 OR late = 0 OR YEAR(z) < 2000 THEN 'not eligible' ELSE 'forecast' END AS state, CAST(1 AS BIGINT) AS places FROM last""")
def _(spark, d):
    """Every series is in exactly one of forecast and the list of bad series."""
    forecast, bad = S.reconciled_run(R.brand_arrays(spark, d), ["k"], 12, 2001, ALL)
    states = forecast.select("k", F.lit("forecast").alias("state")).distinct().unionByName(bad.select("k", F.col("reason").alias("state")))
    return states.groupBy("k").agg(F.min("state").alias("state"), F.count("*").alias("places"))
