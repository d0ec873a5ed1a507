"""Trained models and the runs built on them. Learned numbers have no SQL twin; totals and bounds are tested instead."""

from pyspark.sql import functions as F

from .. import KEY
from ..forecast import models as M
from ..operators import aggregates as A
from ..operators import series as O
from ..plans import documents, po, residual, revenue
from ..session import cut_lineage, scratch_path
from . import query
from . import roles as R
from .joining import DOC_ALL, HISTORY
from .models import _classical_ctes
from .orders import prepared, training
from .roles import big, r, rs, txt


def _forest(spark, d, ready=None):
    """The forest at its full settings, 1,000 trees of depth 2 at rate 0.5, over every training row."""
    features = po.Features()
    table = cut_lineage(training(spark, d, ready=ready).select(*KEY, *features.all(), "target"))
    return (*po.train(table, features), features)


@query("k08_forest_scores")
def _(spark, d):
    """Test-part scores of the forest."""
    _, scores, _ = _forest(spark, d)
    rows = R.table(spark, d, "orders").agg(F.count("*").alias("orders"))
    return rows.select("orders", *[F.lit(v).alias(k.replace("-", "_")) for k, v in scores.items()])


@query("a14_saved_model_repeats_itself")
def _(spark, d):
    """Forecast total by group from the fitted and from the stored model."""
    ready = prepared(spark, d)
    model, _, features = _forest(spark, d, ready)
    path = scratch_path(spark, "model")
    po.save_model(model, path)
    rows = po.inference_rows(ready.orders, ready.history, R.CURR_YEAR, R.CURR_MONTH, 0)
    out = None
    for name, m in (("fitted", model), ("loaded", po.load_model(spark, path))):
        rolled = po.roll_forward(m, rows, 12 - R.CURR_MONTH + 12, features)
        total = rolled.select("fingroup", (F.aggregate("shares", F.lit(0.0), lambda a, x: a + x) * F.col("po_net_value")).alias("v"))
        one = total.groupBy("fingroup").agg(r(F.sum("v")).alias(name))
        out = one if out is None else out.join(one, "fingroup")
    return out


def _forecast(spark, d, forecast_to):
    ready = prepared(spark, d)
    model, _, features = _forest(spark, d, ready)
    steps = 12 - R.CURR_MONTH + 12 * forecast_to
    rows = po.inference_rows(ready.orders, ready.history, R.CURR_YEAR, R.CURR_MONTH, forecast_to)
    rolled = po.roll_forward(model, rows, steps, features)
    past = A.past_sums(ready.invoices, KEY, po.VOLUMES, R.CURR_YEAR, R.CURR_MONTH)
    past = past.join(ready.orders.select(*KEY, "fingroup"), KEY, "left")
    return po.forecast_orders(rolled, past, R.CURR_MONTH, forecast_to)


@query("k10_roll_forward_by_month")
def _(spark, d):
    """Next year's twelve months by group."""
    return po.group_totals(_forecast(spark, d, 1), monthly=True).select("fingroup", big("step").alias("step"), r("amount").alias("amount"))


@query("k11_current_year_with_past")
def _(spark, d):
    """This year's forecast on top of what is already invoiced, by order."""
    x = po.order_totals(_forecast(spark, d, 0))
    return x.select("doc_id", "fingroup", r("amount").alias("amount"))


@query("k11_forecast_parts", sql=f"""
WITH {HISTORY}, aged AS (SELECT *, (2001 - order_year) * 12 + 10 - order_month AS age FROM po_orders WHERE order_year >= 2001 - 7 AND CAST(fund_year AS INT) <= 2001),
open AS (SELECT aged.doc_id FROM aged LEFT JOIN history USING (doc_id, fund_year, item) WHERE age <= 120 GROUP BY aged.doc_id HAVING COALESCE(SUM(CASE WHEN rel_month < age THEN volume END), 0) / MAX(po_net_value) < 0.98),
past AS (SELECT doc_id, SUM(RE + ZY + ZF) AS past FROM po_invoices WHERE invoice_year = 2001 AND invoice_month <= 10 GROUP BY 1)
SELECT COALESCE(open.doc_id, past.doc_id) AS doc_id, CAST(CASE WHEN open.doc_id IS NULL THEN 0 ELSE 12 - 10 END AS BIGINT) AS months, {rs('past')} AS past FROM open FULL JOIN past ON open.doc_id = past.doc_id""")
def _(spark, d):
    """Of this year's forecast, the months ahead of each order and what is already invoiced on it."""
    x = _forecast(spark, d, 0)
    ahead = F.col("step") > 0
    return x.groupBy("doc_id").agg(big(F.sum(ahead.cast("int"))).alias("months"), r(F.sum(F.when(~ahead, F.col("amount")))).alias("past"))


@query("k12_group_totals")
def _(spark, d):
    return po.group_totals(_forecast(spark, d, 0)).select("fingroup", r("amount").alias("amount"))


# --- residual share -------------------------------------------------------------------

RES_KEYS = R.KEYS
FEATURES = ["inviting_partner", "sales_office", "sales_organistion"]
_K = "CONCAT_WS('|', huka, expediture_type, fc3, doc_type)"
RESID = f"""{R.PAYMENTS}, {R.SALES}, mon AS (SELECT {_K} AS k, last_day(payment_date) AS m, SUM(amount) AS v FROM payments GROUP BY 1, 2),
span AS (SELECT k, MIN(m) AS a, MAX(m) AS b FROM mon GROUP BY 1),
grid AS (SELECT k, last_day(CAST(g AS DATE)) AS m FROM span, UNNEST(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) t(g)),
s AS (SELECT grid.k, grid.m, COALESCE(v, 0) AS v, ROW_NUMBER() OVER (PARTITION BY grid.k ORDER BY grid.m) AS i, COUNT(*) OVER (PARTITION BY grid.k) AS n FROM grid LEFT JOIN mon ON mon.k = grid.k AND mon.m = grid.m),
{_classical_ctes('v')},
gate AS (SELECT k FROM parts WHERE ABS(resid) > 1e-6 AND SPLIT_PART(k, '|', 4) = 'RV' GROUP BY 1 HAVING COUNT(*) > {residual.MIN_RESIDUALS}),
attr AS ({' UNION ALL '.join(f"SELECT order_id, '{f}' AS feature, MIN(CAST({f} AS VARCHAR)) AS val FROM sales WHERE {f} IS NOT NULL GROUP BY 1" for f in FEATURES)}),
ft AS (SELECT {_K} AS k, feature, val, last_day(payment_date) AS m, SUM(amount) AS fa FROM payments JOIN attr USING (order_id) WHERE order_id <> '#' GROUP BY 1, 2, 3, 4),
sh AS (SELECT ft.*, resid * fa / NULLIF(v, 0) AS rs FROM ft JOIN parts USING (k, m) JOIN gate USING (k)),
lg AS (SELECT *, {', '.join(f'LAG(rs, {k}) OVER (PARTITION BY k, feature, val ORDER BY m) AS l{k}' for k in residual.LAGS)} FROM sh),
tbl AS (SELECT * FROM lg WHERE rs IS NOT NULL AND {' AND '.join(f'l{k} IS NOT NULL' for k in residual.LAGS)})"""


def _joined_key():
    return F.concat_ws("|", *RES_KEYS)


def _residuals(spark, d):
    """Monthly amount and decomposition residual of the keys that get a residual part."""
    return residual.gated(residual.decomposition_residuals(R.payments(spark, d), RES_KEYS), RES_KEYS)


def _share_table(spark, d, residuals=None):
    rows = residual.feature_months(R.payments(spark, d), R.sales(spark, d), RES_KEYS, FEATURES)
    return residual.share_table(rows, _residuals(spark, d) if residuals is None else residuals, RES_KEYS)


@query("k18_residual_share_table", sql=f"""
WITH {RESID} SELECT k, feature, val AS value, CAST(m AS VARCHAR) AS m, {rs('rs', 1)} AS resid_share, {rs('l1', 1)} AS lag_1, {rs('l12', 1)} AS lag_12 FROM tbl""")
def _(spark, d):
    t = _share_table(spark, d)
    return t.select(_joined_key().alias("k"), "feature", "value", txt("month").alias("m"),
                    r("resid_share", 1).alias("resid_share"), r("resid_share_lag_1", 1).alias("lag_1"), r("resid_share_lag_12", 1).alias("lag_12"))


_USABLE = f"COUNT(*) >= {residual.MIN_ROWS} AND MIN(rs) < MAX(rs) AND MIN(val) < MAX(val)"


@query("k19_usable_keys", sql=f"""
WITH {RESID} SELECT k, feature, CAST(COUNT(*) AS BIGINT) AS rows, CAST(CASE WHEN {_USABLE} THEN 1 ELSE 0 END AS BIGINT) AS usable FROM tbl GROUP BY 1, 2""")
def _(spark, d):
    x = residual.usable_keys(_share_table(spark, d), RES_KEYS)
    return x.select(_joined_key().alias("k"), "feature", "rows", big(F.col("usable").cast("int")).alias("usable"))


# the published models have 500 trees at rate 0.05; a tenth of them at ten times the rate keeps trees x rate
RESID_FIT = {"trees": 50, "depth": 5, "rate": 0.5}
RESID_FROM, RESID_STEPS = "2002-01-31", 12


def _resid_parts(spark, d, per_value=False):
    left_over = cut_lineage(_residuals(spark, d))
    table = cut_lineage(_share_table(spark, d, left_over))
    model = residual.fit(table, RES_KEYS, **RESID_FIT)
    return left_over, table, residual.roll_forward(model, table, left_over, RES_KEYS, RESID_FROM, RESID_STEPS, per_value=per_value)


def _resid_forecast(spark, d, per_value=False):
    left_over, _, ahead = _resid_parts(spark, d, per_value)
    return residual.total_by_month(ahead, left_over, RES_KEYS, RESID_FROM, RESID_STEPS)


@query("k20_residual_roll_forward")
def _(spark, d):
    """Next year's residual part by key and month, over all order attributes; keys without a model have zeros."""
    x = _resid_forecast(spark, d)
    return x.select(_joined_key().alias("k"), txt("month").alias("m"), r("value").alias("value"))


@query("k20_state_per_value")
def _(spark, d):
    """The same with a state for every value of an attribute."""
    x = _resid_forecast(spark, d, per_value=True)
    return x.select(_joined_key().alias("k"), txt("month").alias("m"), r("value").alias("value"))


def _within_bounds(name, per_value):
    """States of a key, the bounds their sum must keep and, where both bounds meet, the sum itself, month by month."""
    by, pick = ("k, feature, val", "m DESC") if per_value else ("k, feature", "m DESC, val DESC")
    sql = f"""
WITH {RESID}, good AS (SELECT k, feature FROM tbl GROUP BY 1, 2 HAVING {_USABLE}),
last AS (SELECT k, l1 FROM (SELECT tbl.*, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {pick}) AS rn FROM tbl JOIN good USING (k, feature)) q WHERE rn = 1),
sp AS (SELECT k, AVG(resid) AS mu, STDDEV_SAMP(resid) AS sd FROM parts JOIN gate USING (k) WHERE resid IS NOT NULL GROUP BY 1),
ahead AS (SELECT k, mu, sd, h FROM sp, generate_series(0, {RESID_STEPS - 1}) t(h)),
lim AS (SELECT k, h, COUNT(l1) AS states, SUM(LEAST(mu - sd, l1 + 2 * sd * (h + 1))) AS low, SUM(GREATEST(mu + sd, l1 - 2 * sd * (h + 1))) AS high FROM ahead LEFT JOIN last USING (k) GROUP BY 1, 2)
SELECT k, CAST(last_day(DATE '{RESID_FROM}' + to_months(CAST(h AS INTEGER))) AS VARCHAR) AS m, CAST(states AS BIGINT) AS states, {rs('CASE WHEN states = 0 THEN 0 ELSE low END', 0)} AS low, {rs('CASE WHEN states = 0 THEN 0 ELSE high END', 0)} AS high,
 CASE WHEN states = 0 THEN CAST(0 AS DOUBLE) END AS value, CAST(0 AS BIGINT) AS outside FROM lim"""

    def run(spark, d):
        left_over, table, ahead = _resid_parts(spark, d, per_value)
        total = residual.total_by_month(ahead, left_over, RES_KEYS, RESID_FROM, RESID_STEPS)
        start = residual.states(table, left_over, RES_KEYS, per_value)
        step = F.posexplode(F.sequence(F.lit(1), F.lit(RESID_STEPS))).alias("_p", "h")
        wide = 2.0 * F.col("_std") * F.col("h")
        lim = start.select(*RES_KEYS, "_mean", "_std", F.col("resid_share_lag_1").alias("l1"), step).groupBy(*RES_KEYS, "h").agg(
            F.count("*").alias("states"),
            F.sum(F.least(F.col("_mean") - F.col("_std"), F.col("l1") + wide)).alias("low"),
            F.sum(F.greatest(F.col("_mean") + F.col("_std"), F.col("l1") - wide)).alias("high"))
        at = F.col("h") == (F.year("month") - 2002) * 12 + F.month("month")
        both = total.alias("t").join(lim.alias("l"), [F.col(f"t.{k}").eqNullSafe(F.col(f"l.{k}")) for k in RES_KEYS] + [at], "left")
        low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(0.0))
        return both.select(
            F.concat_ws("|", *[f"t.{k}" for k in RES_KEYS]).alias("k"), txt("month").alias("m"), big(F.coalesce("states", F.lit(0))).alias("states"),
            r(low, 0).alias("low"), r(high, 0).alias("high"), F.when(F.col("states").isNull(), F.col("value")).alias("value"),
            big((~F.col("value").between(low - 1e-6, high + 1e-6)).cast("int")).alias("outside"))
    query(name, sql=sql)(run)


_within_bounds("k20_bounds", False)
_within_bounds("k20_bounds_per_value", True)


# --- sequences and runs ------------------------------------------------------------------

SEQUENCE_SEED = 3


def _documents(spark, d):
    return documents.combine(R.doc_invoices(spark, d), R.doc_orders(spark, d), R.doc_funds(spark, d))


@query("k21_sequence_forecast")
def _(spark, d):
    """One boosted model over all document series: the year 2000 from the years before and its first months, and 2001."""
    x = documents.sequence_forecast(_documents(spark, d), 2000, 1e4, seed_months=SEQUENCE_SEED, noise=0.01)
    return x.select("doc", F.col("group").alias("grp"), big("year").alias("year"), r("forecast").alias("forecast"), r("actual").alias("actual"), r("abs_err").alias("abs_err"))


@query("k21_known_months", sql=f"""
WITH {DOC_ALL}, allrows AS (SELECT doc, grp, year, month, volume FROM inv UNION ALL SELECT * FROM clipped),
mon AS (SELECT doc, grp, year, month, SUM(volume) AS v FROM allrows WHERE year <= 2000 GROUP BY 1, 2, 3, 4),
keep AS (SELECT doc, grp FROM (SELECT doc, grp, year, SUM(v) AS v FROM mon GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING AVG(ABS(v)) > 1e4),
span AS (SELECT MIN(year * 12 + month - 1) AS a, MAX(year * 12 + month - 1) AS z FROM mon JOIN keep USING (doc, grp)),
dense AS (SELECT doc, grp, t AS mi, COALESCE(v, 0) AS v FROM (SELECT doc, grp, CAST(unnest(range(a, z + 1)) AS BIGINT) AS t FROM keep, span) LEFT JOIN (SELECT doc, grp, year * 12 + month - 1 AS t, v FROM mon) USING (doc, grp, t)),
whole AS (SELECT doc, grp, mi // 12 AS y FROM dense WHERE mi // 12 < 2000 GROUP BY 1, 2, 3 HAVING COUNT(*) = 12),
bound AS (SELECT doc, grp, MIN(v) AS low, MAX(v) AS high FROM dense d JOIN whole w USING (doc, grp) WHERE d.mi // 12 = w.y GROUP BY 1, 2),
ahead AS (SELECT doc, grp, low, high, CAST(unnest(range(24000, 24024)) AS BIGINT) AS mi FROM bound)
SELECT doc, grp, CAST(mi // 12 AS BIGINT) AS year, CAST(mi % 12 + 1 AS BIGINT) AS month, CAST(mi < 24000 + {SEQUENCE_SEED} AS BIGINT) AS known,
 CASE WHEN mi < 24000 + {SEQUENCE_SEED} THEN {rs('CASE WHEN high = low THEN low ELSE GREATEST(v, low) END')} END AS value
FROM ahead LEFT JOIN dense USING (doc, grp, mi)""")
def _(spark, d):
    """All 24 months of every series: the known ones keep their value, the forecast ones are null here."""
    x = documents.sequence_months(_documents(spark, d), 2000, 1e4, seed_months=SEQUENCE_SEED, trees=1)
    return x.select("doc", F.col("group").alias("grp"), big(F.year("month")).alias("year"), big(F.month("month")).alias("month"),
                    big(F.col("known").cast("int")).alias("known"), F.when(F.col("known"), r("value")).alias("value"))


@query("k22_noise_in_the_fit")
def _(spark, d):
    """Yearly forecasts of the model fitted without noise and with noisy replicas of its rows."""
    out = None
    for name, noise in (("clean", 0.0), ("noisy", 0.01)):
        x = documents.sequence_forecast(_documents(spark, d), 2000, 1e4, seed_months=SEQUENCE_SEED, noise=noise)
        one = x.select("doc", F.col("group").alias("grp"), big("year").alias("year"), r("forecast").alias(name))
        out = one if out is None else out.join(one, ["doc", "grp", "year"])
    return out


@query("k22_noisy_inputs")
def _(spark, d):
    """Mean shift of the lag inputs under noise of one hundredth."""
    scaled = O.min_max_scale(R.brand_months(spark, d).withColumnRenamed("m", "month"), ["k"], "v")
    clean = documents.lag_table(scaled, ["k"]).select("k", "month", F.col("scaled_lag_1").alias("a"))
    noisy = documents.lag_table(scaled, ["k"], noise=0.01, seed=3).select("k", "month", F.col("scaled_lag_1").alias("b"))
    gap = F.col("b") - F.col("a")
    return clean.join(noisy, ["k", "month"]).groupBy("k").agg(F.avg(gap).alias("shift"), F.stddev(gap).alias("spread"))


@query("n02_caller_model", sql=f"""
WITH {R.BRAND} SELECT k, CAST(h AS BIGINT) AS step, {rs('MAX_BY(v, i) * POW(0.9, h)')} AS value FROM s, generate_series(1, 3) t(h) GROUP BY k, h""")
def _(spark, d):
    def fading(values, steps):
        return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda h: F.element_at(values, -1) * F.pow(F.lit(0.9), h))
    x = M.forecast(R.brand_arrays(spark, d), ["k"], fading, 3)
    return x.select("k", big("step").alias("step"), r("value").alias("value"))


@query("r01_yearly_revenue_run")
def _(spark, d):
    """The whole revenue batch over every key combination, beside three actual years."""
    keys = R.KEYS
    p = R.payments(spark, d).where(F.col("payment_date") <= F.lit(R.CLOSED_TO).cast("date"))
    x = revenue.run(p, keys, R.CLOSED_TO, 2002, [1999, 2000, 2001])
    return x.select(*[big(k).alias(k) for k in keys[:3]], "doc_type", *[
        r(c).alias(c) for c in ("total_forecasted_value", "total_forecasted_value_no_resid", "actual_1999", "actual_2000", "actual_2001")])


def _run_with_residuals(spark, d):
    p = R.payments(spark, d).where(F.col("payment_date") <= F.lit(R.CLOSED_TO).cast("date"))
    extra = cut_lineage(_resid_forecast(spark, d))
    return revenue.run(p, RES_KEYS, R.CLOSED_TO, 2002, [1999, 2000, 2001], extra), extra


@query("r02_revenue_run_with_residuals")
def _(spark, d):
    """Revenue by the four keys with the residual part of the boosted model."""
    x, _ = _run_with_residuals(spark, d)
    return x.select(_joined_key().alias("k"), *[
        r(c).alias(c) for c in ("total_forecasted_value", "total_forecasted_value_no_resid", "actual_1999", "actual_2000", "actual_2001")])


@query("r02_residual_part_adds_up", sql=f"""
WITH {R.PAYMENTS}, x AS (SELECT {_K} AS k, SUM(CASE WHEN payment_year = 1999 THEN amount ELSE 0 END) AS a, SUM(CASE WHEN payment_year = 2000 THEN amount ELSE 0 END) AS b,
 SUM(CASE WHEN payment_year = 2001 THEN amount ELSE 0 END) AS c FROM payments WHERE payment_date <= DATE '{R.CLOSED_TO}' GROUP BY 1)
SELECT k, CAST(0 AS BIGINT) AS off FROM x WHERE a <> 0 OR b <> 0 OR c <> 0""")
def _(spark, d):
    """Per key, whether the total departs from base and residual part, but for negative totals, which become 0."""
    x, extra = _run_with_residuals(spark, d)
    yearly = extra.groupBy(*RES_KEYS).agg(F.sum("value").alias("extra"))
    both = x.join(yearly, RES_KEYS, "left")
    total = F.col("total_forecasted_value_no_resid") + F.coalesce("extra", F.lit(0.0))
    sparse = F.col("total_forecasted_value_no_resid") == 0  # forecast by the mean of past years
    gap = F.abs(F.col("total_forecasted_value") - F.greatest(total, F.lit(0.0))) > 0.01
    return both.select(_joined_key().alias("k"), big((gap & ~sparse & (total >= 0)).cast("int")).alias("off"))
