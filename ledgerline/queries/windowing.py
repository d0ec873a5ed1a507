"""Window functions over period rows."""

from pyspark.sql import functions as F

from .. import KEY
from ..operators import aggregates, windows
from ..plans import documents, po, quarterly, revenue
from . import query
from . import roles as R
from .joining import HISTORY, history
from .roles import big, r, rs, txt


@query("f01_running_sum", sql=f"""
WITH {R.DOC_INVOICES}, u AS (SELECT doc, grp, year, month, SUM(volume) AS volume FROM doc_invoices GROUP BY 1, 2, 3, 4)
SELECT doc, grp, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, {rs('SUM(volume) OVER (PARTITION BY doc, grp ORDER BY year, month ROWS UNBOUNDED PRECEDING)')} AS volume FROM u""")
def _(spark, d):
    rows = documents.accumulate(documents.unique_rows(R.doc_invoices(spark, d)))
    return rows.select("doc", F.col("group").alias("grp"), big("year").alias("year"), big("month").alias("month"), r("volume").alias("volume"))


YTD = f"""{R.BUDGET}, m AS (SELECT doc_type, last_day(make_date(financial_year, month_no, 1)) AS m, SUM(volume) AS v FROM budget GROUP BY 1, 2),
ytd AS (SELECT doc_type, m, v, SUM(v) OVER (PARTITION BY doc_type, YEAR(m) ORDER BY m ROWS UNBOUNDED PRECEDING) AS ytd FROM m)"""


def _ytd(spark, d):
    rows = R.budget_rows(spark, d).select(F.col("doc_type").alias("type"), F.lit("all").alias("fingroup"), F.make_date("financial_year", "month_no", F.lit(1)).alias("month"), "volume")
    return quarterly.year_to_date(quarterly.type_series(rows))


@query("f02_year_to_date", sql=f"WITH {YTD} SELECT doc_type, CAST(m AS VARCHAR) AS m, {rs('ytd')} AS ytd FROM ytd")
def _(spark, d):
    return _ytd(spark, d).select(F.col("type").alias("doc_type"), txt("month").alias("m"), r("ytd").alias("ytd"))


@query("f03_undo_year_to_date", sql=f"WITH {YTD} SELECT doc_type, CAST(m AS VARCHAR) AS m, {rs('v')} AS v FROM ytd")
def _(spark, d):
    rows = windows.undo_year_to_date(_ytd(spark, d), ["type"], "month", "ytd", "v")
    return rows.select(F.col("type").alias("doc_type"), txt("month").alias("m"), r("v").alias("v"))


@query("f04_rolling_std", sql=f"""
WITH {R.BRAND}, x AS (SELECT k, m, STDDEV_SAMP(v) OVER w AS sd, COUNT(*) OVER w AS c FROM s WINDOW w AS (PARTITION BY k ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT k, CAST(m AS VARCHAR) AS m, {rs('CASE WHEN c >= 2 THEN sd ELSE -1 END', 3)} AS rolling_std FROM x""")
def _(spark, d):
    x = windows.rolling_std(R.brand_months(spark, d), ["k"], ["m"], "v")
    return x.select("k", txt("m").alias("m"), r(F.coalesce("rolling_std", F.lit(-1.0)), 3).alias("rolling_std"))


@query("f05_centered_mean", sql=f"""
WITH {R.BRAND} SELECT k, CAST(m AS VARCHAR) AS m, {rs('AVG(v) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)', 3)} AS trend FROM s""")
def _(spark, d):
    return windows.centered_mean(R.brand_months(spark, d), ["k"], ["m"], "v").select("k", txt("m").alias("m"), r("trend", 3).alias("trend"))


def _daily(spark, d):
    p = R.payments(spark, d)
    return p.groupBy("huka", "doc_type", F.col("payment_date").alias("day")).agg(F.sum("amount").alias("amount"))


SPIKES = f"""{R.PAYMENTS}, daily AS (SELECT huka, doc_type, payment_date AS day, SUM(amount) AS amount FROM payments GROUP BY 1, 2, 3),
roll AS (SELECT *, AVG(amount) OVER w AS rm, STDDEV_SAMP(amount) OVER w AS rsd, COUNT(*) OVER w AS c FROM daily WINDOW w AS (PARTITION BY huka, doc_type ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
dev AS (SELECT *, CASE WHEN c >= 6 THEN ABS(amount - rm) / NULLIF(rsd, 0) END AS deviation FROM roll)"""


@query("f06_spike_flags", sql=f"""
WITH {SPIKES} SELECT CAST(huka AS BIGINT) AS huka, doc_type, CAST(COUNT(*) AS BIGINT) AS days, CAST(SUM(CASE WHEN deviation > 2.5 THEN 1 ELSE 0 END) AS BIGINT) AS spikes, {rs('MAX(deviation)', 4)} AS largest FROM dev GROUP BY 1, 2""")
def _(spark, d):
    x = windows.flag_spikes(_daily(spark, d), ["huka", "doc_type"], ["day"], "amount", threshold=2.5)
    return x.groupBy(big("huka").alias("huka"), "doc_type").agg(
        F.count("*").alias("days"), big(F.sum(F.col("is_spike").cast("int"))).alias("spikes"), r(F.max("deviation"), 4).alias("largest"))


CLEANED = f"""{SPIKES}, g AS (SELECT huka, doc_type, day, amount, COALESCE(deviation > 2.5, FALSE) AS spike, CASE WHEN COALESCE(deviation > 2.5, FALSE) THEN NULL ELSE amount END AS v FROM dev),
nb AS (SELECT *, LAST_VALUE(v IGNORE NULLS) OVER p AS pv, LAST_VALUE(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER p AS pd, FIRST_VALUE(v IGNORE NULLS) OVER f AS nv, FIRST_VALUE(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER f AS nd
  FROM g WINDOW p AS (PARTITION BY huka, doc_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY huka, doc_type ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cleaned AS (SELECT huka, doc_type, day, amount, spike, CASE WHEN v IS NOT NULL THEN v WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * DATEDIFF('day', pd, day) / DATEDIFF('day', pd, nd) END AS clean FROM nb)"""


def cleaned_days(spark, d):
    return windows.remove_spikes(_daily(spark, d), ["huka", "doc_type"], "day", "amount", threshold=2.5)


@query("f07_interpolate_by_time", sql=f"""
WITH {CLEANED} SELECT CAST(huka AS BIGINT) AS huka, doc_type, CAST(day AS VARCHAR) AS day, {rs('amount')} AS raw, {rs('clean', 3)} AS clean FROM cleaned WHERE spike""")
def _(spark, d):
    x = cleaned_days(spark, d)
    return x.where("is_spike").select(big("huka").alias("huka"), "doc_type", txt("day").alias("day"), r("raw").alias("raw"), r("clean", 3).alias("clean"))


PAY_MONTHS = f"""{R.PAYMENTS}, pm AS (SELECT huka, expediture_type, fc3, doc_type, last_day(payment_date) AS m, SUM(amount) AS v FROM payments GROUP BY ALL),
psp AS (SELECT huka, expediture_type, fc3, doc_type, MIN(m) AS a, MAX(m) AS b FROM pm GROUP BY ALL),
pg AS (SELECT huka, expediture_type, fc3, doc_type, last_day(CAST(g AS DATE)) AS m FROM psp, UNNEST(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) t(g)),
ps AS (SELECT pg.*, COALESCE(v, 0) AS v FROM pg LEFT JOIN pm USING (huka, expediture_type, fc3, doc_type, m))"""
_PK = "huka, expediture_type, fc3, doc_type"
RATED = f"""{PAY_MONTHS}, rated AS (SELECT *, AVG(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) OVER w AS ratio, CASE WHEN COUNT(*) OVER w >= 24 THEN AVG(v) OVER w END AS rmean, CASE WHEN COUNT(*) OVER w >= 24 THEN STDDEV_SAMP(v) OVER w END AS rstd
  FROM ps WINDOW w AS (PARTITION BY {_PK} ORDER BY m ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


def pay_months(spark, d):
    from ..operators.series import densify
    return densify(R.payments(spark, d), R.KEYS, "payment_date", "amount")


@query("f08_activity", sql=f"""
WITH {RATED} SELECT doc_type, CAST(m AS VARCHAR) AS m, {rs('SUM(ratio)', 5)} AS ratio, {rs('SUM(COALESCE(rmean, 0))')} AS rmean, {rs('SUM(COALESCE(rstd, 0))')} AS rstd, {rs('SUM(COALESCE(rstd / NULLIF(ABS(rmean), 0), 0))', 4)} AS cv FROM rated GROUP BY 1, 2""")
def _(spark, d):
    x = windows.activity(pay_months(spark, d), R.KEYS, "month", "amount")
    def total(c, n=2):
        return r(F.sum(F.coalesce(c, F.lit(0.0))), n)
    return x.groupBy("doc_type", txt("month").alias("m")).agg(
        total("activity_ratio", 5).alias("ratio"), total("activity_mean").alias("rmean"), total("activity_std").alias("rstd"), total("activity_cv", 4).alias("cv"))


@query("f09_lag_features", sql=f"""
WITH {R.BRAND} SELECT k, CAST(m AS VARCHAR) AS m, {', '.join(f"{rs(f'COALESCE(LAG(v, {n}) OVER (PARTITION BY k ORDER BY m), -1)')} AS lag_{n}" for n in (1, 3, 6, 12))} FROM s""")
def _(spark, d):
    x = windows.lags(R.brand_months(spark, d), ["k"], ["m"], "v")
    return x.select("k", txt("m").alias("m"), *[r(F.coalesce(f"v_lag_{n}", F.lit(-1.0))).alias(f"lag_{n}") for n in (1, 3, 6, 12)])


@query("f10_block_mean", sql=f"""
WITH {R.BRAND} SELECT k, CAST(i - 1 AS BIGINT) AS position, {rs('AVG(v) OVER (PARTITION BY k, (i - 1) // 4)', 4)} AS smoothed FROM s""")
def _(spark, d):
    from pyspark.sql import Window
    at = F.row_number().over(Window.partitionBy("k").orderBy("m")) - 1
    x = windows.block_mean(R.brand_months(spark, d).withColumn("position", at), ["k"], "position", "v", 4, "smoothed")
    return x.select("k", big("position").alias("position"), r("smoothed", 4).alias("smoothed"))


PORTION = f"""{HISTORY}, h AS (SELECT doc_id, fund_year, item, rel_month, volume, po_net_value FROM history JOIN po_orders USING (doc_id, fund_year, item)),
b AS (SELECT *, COALESCE(SUM(volume) OVER (PARTITION BY doc_id, fund_year, item ORDER BY rel_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)"""


def _history_with_value(spark, d):
    orders, past = history(spark, d)
    return past.join(orders.select(*KEY, "po_net_value"), KEY)


@query("f11_cumulative_portion", sql=f"WITH {PORTION} SELECT doc_id, CAST(rel_month AS BIGINT) AS rel_month, {rs('before / po_net_value', 7)} AS cumulative_portion FROM b")
def _(spark, d):
    x = windows.cumulative_portion(_history_with_value(spark, d), KEY, "rel_month", "volume", "po_net_value")
    return x.select("doc_id", big("rel_month").alias("rel_month"), r("cumulative_portion", 7).alias("cumulative_portion"))


@query("f12_balance_share", sql=f"WITH {PORTION} SELECT doc_id, CAST(rel_month AS BIGINT) AS rel_month, CASE WHEN ABS(po_net_value - before) > 100 THEN {rs('volume / (po_net_value - before)', 5)} END AS target FROM b")
def _(spark, d):
    x = _history_with_value(spark, d)
    x = windows.cumulative_before(windows.balance_share(x, KEY, "rel_month", "volume", "po_net_value"), KEY, "rel_month", "volume", "before")
    # near a zero balance the share depends on the last bit of the sums, so only that there is a row is compared there
    steady = F.abs(F.col("po_net_value") - F.col("before")) > 100
    return x.select("doc_id", big("rel_month").alias("rel_month"), F.when(steady, r("target", 5)).alias("target"))


@query("f13_group_total", sql=f"""
WITH {HISTORY} SELECT doc_id, CAST(rel_month AS BIGINT) AS rel_month, {rs('SUM(volume) OVER (PARTITION BY doc_id, fund_year, item)')} AS total FROM history""")
def _(spark, d):
    x = windows.group_total(history(spark, d)[1], KEY, "volume", "total")
    return x.select("doc_id", big("rel_month").alias("rel_month"), r("total").alias("total"))


@query("f14_last_and_previous_year", sql=f"""
WITH {R.BRAND} SELECT k, {rs('SUM(CASE WHEN i > n - 12 THEN v ELSE 0 END)')} AS last_sum, {rs('SUM(CASE WHEN i > n - 24 AND i <= n - 12 THEN v ELSE 0 END)')} AS previous_sum FROM s GROUP BY 1""")
def _(spark, d):
    x = windows.last_and_previous(R.brand_months(spark, d), ["k"], "m", "v")
    return x.select("k", r("last_sum").alias("last_sum"), r("previous_sum").alias("previous_sum"))


@query("f15_active_start", sql=f"""
WITH {RATED}, q AS (SELECT {_PK}, COALESCE(QUANTILE_CONT(CASE WHEN v > 0 THEN v END, 0.25), 0) AS q FROM ps GROUP BY ALL),
ahead AS (SELECT rated.*, q, SUM(ratio) OVER w AS ahead, MAX(m) OVER w AS ahead_end FROM rated JOIN q USING ({_PK}) WINDOW w AS (PARTITION BY {_PK} ORDER BY m ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)),
st AS (SELECT {_PK}, MIN(m) AS first, MAX_BY(ahead_end, m) FILTER (WHERE ahead = 0) AS quiet_end, MIN(m) FILTER (WHERE ratio >= 0.5 AND rmean >= q) AS valid FROM ahead GROUP BY ALL)
SELECT CAST(huka AS BIGINT) AS huka, CAST(expediture_type AS BIGINT) AS expediture_type, CAST(fc3 AS BIGINT) AS fc3, doc_type, CAST(GREATEST(COALESCE(quiet_end, first), COALESCE(valid, first)) AS VARCHAR) AS active_from FROM st""")
def _(spark, d):
    x = windows.active_start(pay_months(spark, d), R.KEYS, "month", "amount")
    return x.select(*[big(k).alias(k) for k in R.KEYS[:3]], "doc_type", txt("active_from").alias("active_from"))


@query("f16_average_rank", sql=f"""
WITH {R.DAYS}, x AS (SELECT k, day, FLOOR(v / 50) AS level FROM days)
SELECT k, CAST(day AS VARCHAR) AS day, RANK() OVER (PARTITION BY k ORDER BY level) + (COUNT(*) OVER (PARTITION BY k, level) - 1) / 2.0 AS rank FROM x""")
def _(spark, d):
    e = R.table(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    x = windows.average_rank(e.withColumn("level", F.floor(F.col("v") / 50)), ["k"], "level")
    return x.select("k", txt("day").alias("day"), "rank")


@query("f17_cumulative_forecast", sql=f"""
WITH {R.BRAND}, f AS (SELECT k, SUM(v) FILTER (WHERE i > n - 12) / 12 AS level FROM s GROUP BY 1)
SELECT k, CAST(h AS BIGINT) AS step, {rs('level * h')} AS running FROM f, UNNEST(generate_series(1, 6)) t(h)""")
def _(spark, d):
    from ..forecast.models import forecast
    from ..functions import arrays as A
    from ..operators.series import as_arrays
    flat = lambda v, n: F.array_repeat(A.total(A.tail(v, 12)) / 12.0, F.lit(n))
    ahead = forecast(R.brand_arrays(spark, d), ["k"], flat, 6)
    x = windows.running_sum(ahead, ["k"], ["step"], "value", "running")
    return x.select("k", big("step").alias("step"), r("running").alias("running"))


_STATS = {"mean": "AVG({0})", "std": "STDDEV_SAMP({0})", "max": "MAX({0})", "cv": "STDDEV_SAMP({0}) / NULLIF(AVG({0}), 0)"}


@query("e19_change_after_cleaning", sql=f"""
WITH {CLEANED} SELECT CAST(huka AS BIGINT) AS huka, doc_type, {', '.join(f"{rs(f'({e.format("amount")} - {e.format("clean")}) / NULLIF({e.format("amount")}, 0)', 6)} AS {n}_change" for n, e in _STATS.items())} FROM cleaned GROUP BY 1, 2""")
def _(spark, d):
    """Relative change of the daily statistics of every key by the cleaning of spikes, over all its days."""
    x = cleaned_days(spark, d)
    keys = ["huka", "doc_type"]
    before, after = (aggregates.describe(x, keys, c).select(*keys, *[F.col(n).alias(f"{c}_{n}") for n in _STATS]) for c in ("raw", "clean"))
    both = before.join(after, keys)
    return both.select(big("huka").alias("huka"), "doc_type", *[r(F.try_divide(F.col(f"raw_{n}") - F.col(f"clean_{n}"), f"raw_{n}"), 6).alias(f"{n}_change") for n in _STATS])
