"""Forecast evaluation."""

from pyspark.sql import functions as F

from ..operators import aggregates, evaluate
from . import query
from . import roles as R
from .roles import big, r, rs, txt

SLICED = f"""{R.TRUTH}, top30 AS (SELECT k FROM truth ORDER BY actual DESC, k LIMIT 30), suf AS (SELECT SPLIT_PART(k, '/', 2) AS x FROM truth GROUP BY 1 HAVING COUNT(*) > 1),
sl AS (SELECT 'all' AS slice, truth.* FROM truth UNION ALL SELECT k, truth.* FROM truth WHERE k = '1600/14' UNION ALL SELECT 'TOP 30', truth.* FROM truth WHERE k IN (SELECT k FROM top30)
  UNION ALL SELECT SPLIT_PART(k, '/', 1), truth.* FROM truth WHERE starts_with(k, '1525') OR starts_with(k, '1600') UNION ALL SELECT SPLIT_PART(k, '/', 2), truth.* FROM truth WHERE SPLIT_PART(k, '/', 2) IN (SELECT x FROM suf) UNION ALL SELECT cluster, truth.* FROM truth)"""
_R2 = "CASE WHEN COUNT(*) >= 2 THEN 1 - SUM((actual - predicted) * (actual - predicted)) / NULLIF(VAR_POP(actual) * COUNT(*), 0) END"
_RMSE = "SQRT(AVG((actual - predicted) * (actual - predicted)))"
_LOG = "SQRT(AVG(CASE WHEN actual > 0 AND predicted > 0 THEN (LN(actual) - LN(predicted)) * (LN(actual) - LN(predicted)) END))"
_WIN = "AVG(CASE WHEN ABS(actual - predicted) < ABS(actual - alternative) THEN 1.0 ELSE 0.0 END)"


def _sliced(spark, d):
    t = R.truth(spark, d)
    part = lambda c: t.select("k", F.col(c).alias("value"))
    data = evaluate.paired(part("predicted"), part("actual"), t.select("k", "cluster"), "k", part("alternative"))
    return evaluate.slices(data, "k", "1600/14", ["1525", "1600"], "cluster")


def _metric(name, metric, sql, digits):
    def run(spark, d):
        x = evaluate.scores(_sliced(spark, d), metrics={"score": metric})
        return x.select("slice", r(F.coalesce("score", F.lit(-99.0)), digits).alias("score"))
    query(name, sql=f"WITH {SLICED} SELECT slice, {rs(f'COALESCE({sql}, -99)', digits)} AS score FROM sl GROUP BY 1")(run)


_metric("l02_r2_by_slice", evaluate.r2, _R2, 6)
_metric("l02_rmse_by_slice", evaluate.rmse, _RMSE, 3)
_metric("l03_log_rmse_by_slice", evaluate.log_rmse, _LOG, 6)
_metric("l04_win_share_by_slice", evaluate.win_share, _WIN, 6)


@query("l01_slice_sizes", sql=f"WITH {SLICED} SELECT slice, CAST(COUNT(*) AS BIGINT) AS keys, {rs('SUM(actual)')} AS actual FROM sl GROUP BY 1")
def _(spark, d):
    return _sliced(spark, d).groupBy("slice").agg(F.count("*").alias("keys"), r(F.sum("actual")).alias("actual"))


@query("l05_slice_metric_matrix", sql=f"""
WITH {SLICED} SELECT slice, {rs(f'COALESCE({_R2}, -99)', 6)} AS r2_score, {rs(_RMSE, 3)} AS root_mean_squared_error, {rs(f'COALESCE({_LOG}, -99)', 6)} AS log_rmse, {rs(_WIN, 6)} AS comparison FROM sl GROUP BY 1""")
def _(spark, d):
    x = evaluate.scores(_sliced(spark, d))
    digits = {"r2_score": 6, "root_mean_squared_error": 3, "log_rmse": 6, "comparison": 6}
    return x.select("slice", *[r(F.coalesce(c, F.lit(-99.0)), n).alias(c) for c, n in digits.items()])


@query("n01_caller_metric", sql=f"WITH {SLICED} SELECT slice, {rs('SUM(ABS(actual - predicted)) / SUM(actual)', 6)} AS wape FROM sl GROUP BY 1")
def _(spark, d):
    wape = lambda: F.sum(F.abs(F.col("actual") - F.col("predicted"))) / F.sum("actual")
    return evaluate.scores(_sliced(spark, d), metrics={"wape": wape}).select("slice", r("wape", 6).alias("wape"))


def _last_year(spark, d, keys):
    return aggregates.sum_by(R.payments(spark, d).where("payment_year = 2000"), keys, "amount")


@query("l06_forecast_vs_actual_years", sql=f"""
WITH {R.PAYMENTS}, a AS (SELECT huka, fc3, {', '.join(f'SUM(CASE WHEN payment_year = {y} THEN amount ELSE 0 END) AS a{y}' for y in (1999, 2000, 2001))}, SUM(CASE WHEN payment_year = 2000 THEN amount END) AS f FROM payments GROUP BY 1, 2)
SELECT CAST(huka AS BIGINT) AS huka, CAST(fc3 AS BIGINT) AS fc3, {rs('COALESCE(f, 0)')} AS forecast, {rs('a1999')} AS actual_1999, {rs('a2000')} AS actual_2000, {rs('a2001')} AS actual_2001 FROM a WHERE a1999 <> 0 OR a2000 <> 0 OR a2001 <> 0""")
def _(spark, d):
    f = _last_year(spark, d, ["huka", "fc3"]).withColumnRenamed("amount", "forecast")
    x = evaluate.against_actual_years(f, R.payments(spark, d), ["huka", "fc3"], "payment_year", "amount", [1999, 2000, 2001])
    return x.select(big("huka").alias("huka"), big("fc3").alias("fc3"), *[r(c).alias(c) for c in ("forecast", "actual_1999", "actual_2000", "actual_2001")])


@query("l07_yearly_errors", sql=f"""
WITH {R.TRUTH}, e AS (SELECT k, CASE WHEN a = 0 THEN 0 ELSE predicted END AS f, a FROM (SELECT k, predicted, CASE WHEN actual < 30000 THEN 0 ELSE actual END AS a FROM truth) q)
SELECT k, {rs('a')} AS actual, {rs('f')} AS forecast, {rs('ABS(f - a)')} AS abs_err, ROUND(ABS(f - a) / NULLIF(a, 0), 2) AS rel_err FROM e""")
def _(spark, d):
    t = R.truth(spark, d).select("k", F.col("predicted").alias("forecast"), F.when(F.col("actual") < 30000, 0.0).otherwise(F.col("actual")).alias("actual"))
    x = evaluate.yearly_errors(t, [F.desc("actual"), "k"])
    return x.select("k", r("actual").alias("actual"), r("forecast").alias("forecast"), r("abs_err").alias("abs_err"), "rel_err")


@query("l08_history_with_forecast", sql=f"""
WITH {R.PAYMENTS}, f AS (SELECT fc3, SUM(amount) AS v FROM payments WHERE payment_year = 2000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4)
SELECT CAST(fc3 AS BIGINT) AS fc3, CAST(payment_year AS BIGINT) AS year, {rs('SUM(amount)')} AS amount FROM payments WHERE fc3 IN (SELECT fc3 FROM f) GROUP BY 1, 2 UNION ALL SELECT CAST(fc3 AS BIGINT), 2002, {rs('v')} FROM f""")
def _(spark, d):
    f = _last_year(spark, d, ["huka", "fc3"]).withColumnRenamed("amount", "value")
    x = evaluate.history_with_forecast(R.payments(spark, d), f, "fc3", "payment_year", "amount", 2002, 4)
    return x.select(big("fc3").alias("fc3"), big("year").alias("year"), r("amount").alias("amount"))
