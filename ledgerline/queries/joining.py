"""Joins and set operators."""

from pyspark.sql import functions as F

from .. import KEY
from ..functions import scalars as S
from ..operators import aggregates, evaluate, joins, windows
from ..plans import documents, po, quarterly, spend
from . import query
from . import roles as R
from .roles import big, r, rs, txt


@query("d01_orders_with_dates", sql=f"""
WITH {R.PO_ORDERS} SELECT CAST(order_year AS BIGINT) AS order_year, CAST(order_month AS BIGINT) AS order_month, CAST(COUNT(*) AS BIGINT) AS orders, {rs('SUM(po_net_value)')} AS value FROM po_orders GROUP BY 1, 2""")
def _(spark, d):
    o = po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d))
    return o.groupBy(big("order_year").alias("order_year"), big("order_month").alias("order_month")).agg(
        F.count("*").alias("orders"), r(F.sum("po_net_value")).alias("value"))


HISTORY = f"""{R.PO_ORDERS}, {R.PO_INVOICES},
history AS (SELECT o.doc_id, o.fund_year, o.item, CAST(GREATEST((COALESCE(invoice_year, order_year) - order_year) * 12 + COALESCE(invoice_month, order_month) - order_month, 0) AS INT) AS rel_month,
  SUM(COALESCE(RE + ZY + ZF, 0)) AS volume FROM po_orders o LEFT JOIN po_invoices i USING (doc_id, fund_year, item) GROUP BY 1, 2, 3, 4)"""


def history(spark, d):
    orders = po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d))
    return orders, po.invoice_history(orders, po.prepare_invoices(R.po_invoices(spark, d)))


@query("d02_invoice_history", sql=f"""
WITH {HISTORY} SELECT doc_id, CAST(rel_month AS BIGINT) AS rel_month, {rs('volume')} AS volume FROM history""")
def _(spark, d):
    return history(spark, d)[1].select("doc_id", big("rel_month").alias("rel_month"), r("volume").alias("volume"))


@query("d03_orders_to_history", sql=f"""
WITH {HISTORY} SELECT fingroup, CAST(COUNT(DISTINCT doc_id) AS BIGINT) AS orders, {rs('SUM(volume)')} AS volume FROM po_orders LEFT JOIN history USING (doc_id, fund_year, item) GROUP BY 1""")
def _(spark, d):
    orders, past = history(spark, d)
    totals = past.groupBy(*KEY).agg(F.sum("volume").alias("volume"))
    joined = joins.left_fill(orders, totals, KEY, ["volume"])
    return joined.groupBy("fingroup").agg(F.count("*").alias("orders"), r(F.sum("volume")).alias("volume"))


@query("d04_edits_within_age", sql=f"""
WITH {R.PO_ORDERS}, {R.PO_EDITS}, copies AS (SELECT doc_id, fund_year, item, order_year * 12 + order_month AS order_abs, CAST(a AS INT) AS age FROM po_orders, UNNEST(generate_series(0, 24)) t(a))
SELECT doc_id, CAST(age AS BIGINT) AS age, {rs('SUM(volume)')} AS value FROM copies JOIN po_edits USING (doc_id, fund_year, item) WHERE edit_abs BETWEEN order_abs AND order_abs + age GROUP BY 1, 2""")
def _(spark, d):
    orders = po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d))
    dated = orders.select(*KEY, S.absolute_month("order_year", "order_month").alias("order_abs"))
    rows = joins.edit_sums_as_of(dated, po.prepare_edits(R.po_edits(spark, d)), KEY, ages=F.sequence(F.lit(0), F.lit(24)))
    return rows.select("doc_id", big("age").alias("age"), r("volume").alias("value"))


COMBINED = R.PAYMENTS + ", " + R.SALES + """,
paid AS (SELECT huka, expediture_type, order_id, payment_year AS year, SUM(amount) AS amount FROM payments GROUP BY 1, 2, 3, 4),
ordered AS (SELECT order_id, budget_year AS year, SUM(sales_order_sum) AS sales_order_sum FROM sales GROUP BY 1, 2),
combined AS (SELECT paid.*, COALESCE(sales_order_sum, 0) AS sales_order_sum FROM paid LEFT JOIN ordered USING (order_id, year))"""


def combined(spark, d):
    return spend.payments_with_orders(R.payments(spark, d), R.sales(spark, d), ["huka", "expediture_type"])


@query("d05_payments_with_orders", sql=f"""
WITH {COMBINED} SELECT CAST(huka AS BIGINT) AS huka, CAST(year AS BIGINT) AS year, {rs('SUM(amount)')} AS amount, {rs('SUM(sales_order_sum)')} AS ordered FROM combined GROUP BY 1, 2""")
def _(spark, d):
    return combined(spark, d).groupBy(big("huka").alias("huka"), big("year").alias("year")).agg(
        r(F.sum("amount")).alias("amount"), r(F.sum("sales_order_sum")).alias("ordered"))


@query("d06_join_with_suffixes", sql=f"""
WITH {R.PAYMENTS}, a AS (SELECT budget_year, zroa, SUM(amount) AS amount FROM payments WHERE order_id <> '#' GROUP BY 1, 2), b AS (SELECT budget_year, zroa, SUM(amount) AS amount FROM payments WHERE order_id = '#' GROUP BY 1, 2)
SELECT CAST(budget_year AS BIGINT) AS budget_year, CAST(zroa AS BIGINT) AS zroa, {rs('a.amount')} AS amount_on, {rs('b.amount')} AS amount_off FROM a JOIN b USING (budget_year, zroa)""")
def _(spark, d):
    p = R.payments(spark, d)
    on = aggregates.sum_by(spend.registered(p), ["budget_year", "zroa"], "amount")
    off = aggregates.sum_by(spend.unregistered(p), ["budget_year", "zroa"], "amount")
    both = joins.join_with_suffixes(on, off, ["budget_year", "zroa"], ("_on", "_off"))
    return both.select(big("budget_year").alias("budget_year"), big("zroa").alias("zroa"), r("amount_on").alias("amount_on"), r("amount_off").alias("amount_off"))


OVER = R.PAYMENTS + ", " + R.SALES + """,
over_orders AS (SELECT order_id, amount, COALESCE(s, 0) AS ordered, amount - COALESCE(s, 0) AS diff FROM
  (SELECT order_id, SUM(amount) AS amount FROM payments WHERE order_id <> '#' GROUP BY 1) p LEFT JOIN (SELECT order_id, SUM(sales_order_sum) AS s FROM sales GROUP BY 1) q USING (order_id)
  WHERE amount - COALESCE(s, 0) > 0)"""


@query("d07_order_overrun", sql=f"WITH {OVER} SELECT order_id, {rs('amount')} AS amount, {rs('ordered')} AS ordered, {rs('diff')} AS diff FROM over_orders")
def _(spark, d):
    o = spend.overrun(R.payments(spark, d), R.sales(spark, d))
    return o.select("order_id", r("amount").alias("amount"), r("sales_order_sum").alias("ordered"), r("diff").alias("diff"))


@query("d08_yearly_actual_columns", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(huka AS BIGINT) AS huka, doc_type, {', '.join(f"{rs(f'SUM(CASE WHEN payment_year = {y} THEN amount ELSE 0 END)')} AS actual_{y}" for y in (1999, 2000, 2001))}
FROM payments GROUP BY 1, 2""")
def _(spark, d):
    p = R.payments(spark, d).withColumn("huka", big("huka"))
    empty = p.select("huka", "doc_type").distinct()
    out = evaluate.against_actual_years(empty, p, ["huka", "doc_type"], "payment_year", "amount", [1999, 2000, 2001])
    return out.select("huka", "doc_type", *[r(f"actual_{y}").alias(f"actual_{y}") for y in (1999, 2000, 2001)])


_LARGE = {c: f"{c} > (SELECT AVG({c}) / 2 FROM truth)" for c in ("predicted", "actual", "alternative")}


def _large(t, c):
    """The keys whose total is over half the mean, so that the sides of a join lack different keys."""
    return t.where(F.col(c) > t.agg(F.avg(c) / 2).scalar())


def _sided(spark, d):
    t = R.truth(spark, d)
    return t, *[_large(t, c).select("k", F.col(c).alias("value")) for c in ("predicted", "actual")]


@query("d09_forecast_outer_truth", sql=f"""
WITH {R.TRUTH}, f AS (SELECT k, predicted FROM truth WHERE {_LARGE["predicted"]}), a AS (SELECT k, actual FROM truth WHERE {_LARGE["actual"]})
SELECT k, {rs('COALESCE(predicted, 0)')} AS predicted, {rs('COALESCE(actual, 0)')} AS actual FROM f FULL JOIN a USING (k)""")
def _(spark, d):
    _, f, a = _sided(spark, d)
    both = joins.outer_fill(f.withColumnRenamed("value", "predicted"), a.withColumnRenamed("value", "actual"), ["k"], ["predicted", "actual"])
    return both.select("k", r("predicted").alias("predicted"), r("actual").alias("actual"))


@query("d10_reindex_to_dimension", sql=f"""
WITH {R.TRUTH}, f AS (SELECT k, predicted FROM truth WHERE {_LARGE["predicted"]}) SELECT t.k, {rs('COALESCE(f.predicted, 0)')} AS predicted FROM truth t LEFT JOIN f USING (k) WHERE cluster <> 'high std'""")
def _(spark, d):
    t, f, _ = _sided(spark, d)
    out = joins.reindex_to(t.where(F.col("cluster") != "high std"), f, ["k"], ["value"])
    return out.select("k", r("value").alias("predicted"))


@query("d11_common_keys", sql=f"""
WITH {R.TRUTH} SELECT k, {rs('actual')} AS actual FROM truth WHERE {' AND '.join(_LARGE.values())}""")
def _(spark, d):
    t, f, a = _sided(spark, d)
    alt = _large(t, "alternative").select("k", "alternative")
    both = joins.common_keys(f.withColumnRenamed("value", "predicted"), a.withColumnRenamed("value", "actual"), alt, on=["k"])
    return both.select("k", r("actual").alias("actual"))


@query("d12_semi_and_anti", sql=f"""
WITH {R.PAYMENTS}, {R.SALES}, hit AS (SELECT DISTINCT order_id FROM payments WHERE fc4 = 1007 AND order_id <> '#')
SELECT 'kept' AS part, CAST(COUNT(*) AS BIGINT) AS orders FROM sales WHERE order_id NOT IN (SELECT order_id FROM hit)
UNION ALL SELECT 'hit', CAST(COUNT(*) AS BIGINT) FROM sales WHERE order_id IN (SELECT order_id FROM hit)""")
def _(spark, d):
    p = R.payments(spark, d).withColumn("po_2", F.col("fc4"))
    _, kept = spend.without_obligations(p, R.sales(spark, d), [1007])
    hit = joins.present_in(R.sales(spark, d), spend.registered(p).where(F.col("po_2") == 1007), ["order_id"])
    return kept.agg(F.count("*").alias("orders")).select(F.lit("kept").alias("part"), "orders").unionByName(
        hit.agg(F.count("*").alias("orders")).select(F.lit("hit").alias("part"), "orders"))


@query("d12_anti_join_null_safe", sql=f"""
WITH {R.SALES}, x AS (SELECT CASE WHEN sales_organistion = 'P' THEN NULL ELSE order_id END AS order_id, sales_organistion FROM sales)
SELECT sales_organistion, CAST(COUNT(*) AS BIGINT) AS cnt FROM x WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) = x.order_id) GROUP BY 1""")
def _(spark, d):
    x = R.sales(spark, d).withColumn("order_id", F.when(F.col("sales_organistion") != "P", F.col("order_id")))
    lines = R.table(spark, d, "lineitem").select(txt("l_orderkey").alias("order_id"))
    return joins.not_in(x, lines, ["order_id"]).groupBy("sales_organistion").agg(F.count("*").alias("cnt"))


@query("d13_key_difference", sql=f"""
WITH {R.PAYMENTS}, {R.SALES} SELECT order_id FROM payments EXCEPT SELECT order_id FROM sales""")
def _(spark, d):
    return joins.key_difference(R.payments(spark, d), R.sales(spark, d), ["order_id"])


PAIRS = R.CHANGES + """,
lines AS (SELECT doc_id, MAX(CASE WHEN doc_item = 1 THEN mof_class END) AS class_out, MAX(CASE WHEN doc_item = 2 THEN mof_class END) AS class_in,
  MAX(CASE WHEN doc_item = 1 THEN amount END) AS value, MAX(CASE WHEN doc_item = 1 THEN year END) AS year, MAX(CASE WHEN doc_item = 1 THEN month END) AS month
  FROM changes WHERE fund_code <> 1410 AND doc_item IN (1, 2) GROUP BY 1),
pairs AS (SELECT * FROM lines WHERE class_out IS NOT NULL AND class_in IS NOT NULL)"""


@query("d14_pair_lines", sql=f"WITH {PAIRS} SELECT doc_id, class_out, class_in, {rs('value')} AS value, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month FROM pairs")
def _(spark, d):
    return quarterly.change_pairs(R.change_lines(spark, d)).select(
        "doc_id", "class_out", "class_in", r("value").alias("value"), big("year").alias("year"), big("month").alias("month"))


@query("d15_copies_over_ages", sql=f"""
WITH {R.PO_ORDERS}, y AS (SELECT *, LEAST(10, (2001 * 12 + 10 - order_year * 12 - order_month) // 12) AS k FROM po_orders)
SELECT CAST(age AS BIGINT) AS age, CAST(SUM(k - age // 12) AS BIGINT) AS copies, CAST(COUNT(*) AS BIGINT) AS orders FROM y, UNNEST(generate_series(0, 12 * k - 1)) t(age) WHERE k >= 1 GROUP BY 1""")
def _(spark, d):
    o = po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d)).select(*KEY, "order_year", "order_month")
    copies = joins.copies_over_ages(o, R.CURR_YEAR, R.CURR_MONTH).groupBy("age").agg(F.count("*").alias("copies"))
    single = joins.ages_with_weight(o, R.CURR_YEAR, R.CURR_MONTH).groupBy("age").agg(F.count("*").alias("orders"))
    return copies.join(single, "age").select(big("age").alias("age"), "copies", "orders")


@query("d16_dimension_lookup", sql=f"""
WITH x AS (SELECT n_name, r_name, SUM(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT n_name, r_name, {rs('v')} AS amount FROM x""")
def _(spark, d):
    line, s = R.table(spark, d, "lineitem"), R.table(spark, d, "supplier")
    per_supplier = line.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_extendedprice").alias("v"))
    n = R.table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    g = R.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    joined = per_supplier.join(s, "s_suppkey").join(n, "s_nationkey", "left").join(g, "n_regionkey", "left")
    return joined.groupBy("n_name", "r_name").agg(r(F.sum("v")).alias("amount"))


DOC_ALL = f"""{R.DOC_INVOICES}, {R.DOC_ORDERS}, {R.DOC_FUNDS},
inv AS (SELECT CASE doc WHEN 'ZY' THEN 'RE' WHEN 'ZF' THEN 'RE' WHEN 'KG' THEN 'KR' ELSE doc END AS doc, grp, year, month, volume FROM doc_invoices),
raw2 AS (SELECT doc, grp, year, month, volume, fund_year, 1 AS src FROM doc_orders UNION ALL
  SELECT CAST(CASE doc WHEN 51 THEN 50 WHEN 61 THEN 60 ELSE doc END AS VARCHAR), grp, year, month, volume, fund_year, 2 FROM doc_funds WHERE doc IN (50, 51, 60, 61, 78, 79)),
eff AS (SELECT src, doc, grp, CASE WHEN year < fund_year THEN fund_year ELSE year END AS year, CASE WHEN year < fund_year THEN 1 ELSE month END AS month, volume FROM raw2),
uniq AS (SELECT src, doc, grp, year, month, SUM(volume) AS volume FROM eff GROUP BY 1, 2, 3, 4, 5),
acc AS (SELECT doc, grp, year, month, SUM(volume) OVER (PARTITION BY src, doc, grp ORDER BY year, month ROWS UNBOUNDED PRECEDING) AS volume FROM uniq),
lim AS (SELECT MIN(year) AS a, MAX(year * 12 + month) AS z FROM doc_invoices),
clipped AS (SELECT acc.* FROM acc, lim WHERE year >= a AND year * 12 + month <= z)"""


@query("d17_union_documents", sql=f"""
WITH {DOC_ALL}, allrows AS (SELECT doc, grp, year, month, volume FROM inv UNION ALL SELECT * FROM clipped)
SELECT doc, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, CAST(COUNT(*) AS BIGINT) AS cnt, {rs('SUM(volume)')} AS volume FROM allrows GROUP BY 1, 2, 3""")
def _(spark, d):
    docs = documents.combine(R.doc_invoices(spark, d), R.doc_orders(spark, d), R.doc_funds(spark, d))
    return docs.groupBy("doc", big("year").alias("year"), big("month").alias("month")).agg(F.count("*").alias("cnt"), r(F.sum("volume")).alias("volume"))


@query("d18_align_by_date", sql=f"""
WITH {R.BRAND}, t AS (SELECT k, m, AVG(v) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS trend FROM s),
sd AS (SELECT k, m, STDDEV_SAMP(v) OVER w AS sd, COUNT(*) OVER w AS c FROM s WINDOW w AS (PARTITION BY k ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT t.k, CAST(t.m AS VARCHAR) AS m, {rs('trend', 3)} AS trend, {rs('sd', 3)} AS rolling_std FROM t JOIN sd ON t.k = sd.k AND t.m = sd.m WHERE c >= 2""")
def _(spark, d):
    months = R.brand_months(spark, d)
    trend = windows.centered_mean(months, ["k"], ["m"], "v").select("k", "m", "trend")
    std = windows.rolling_std(months, ["k"], ["m"], "v").where(F.col("rolling_std").isNotNull()).select("k", "m", "rolling_std")
    return joins.align_on(trend, std, ["k", "m"]).select("k", txt("m").alias("m"), r("trend", 3).alias("trend"), r("rolling_std", 3).alias("rolling_std"))


@query("d19_first_order_attribute", sql=f"""
WITH {R.PAYMENTS}, {R.SALES}, f AS (SELECT order_id, MIN(inviting_partner) AS inviting_partner FROM sales GROUP BY 1)
SELECT inviting_partner, {rs('SUM(amount)')} AS amount FROM payments JOIN f USING (order_id) WHERE order_id <> '#' GROUP BY 1""")
def _(spark, d):
    paid = aggregates.sum_by(spend.registered(R.payments(spark, d)), ["order_id"], "amount")
    known = joins.with_order_attribute(paid, R.sales(spark, d), "inviting_partner", ["inviting_partner"])
    return known.groupBy("inviting_partner").agg(r(F.sum("amount")).alias("amount"))


@query("d20_month_keyed_left_join", sql=f"""
WITH {R.PAYMENTS}, a AS (SELECT huka, doc_type, last_day(payment_date) AS m, SUM(amount) AS v FROM payments GROUP BY 1, 2, 3), b AS (SELECT huka, last_day(payment_date) AS m, SUM(amount) AS whole FROM payments WHERE order_id <> '#' GROUP BY 1, 2)
SELECT CAST(huka AS BIGINT) AS huka, doc_type, CAST(m AS VARCHAR) AS m, {rs('v')} AS amount, {rs('COALESCE(whole, 0)')} AS whole FROM a LEFT JOIN b USING (huka, m)""")
def _(spark, d):
    p = R.payments(spark, d)
    parts = aggregates.monthly(p, ["huka", "doc_type"], "payment_date", "amount")
    whole = aggregates.monthly(spend.registered(p), ["huka"], "payment_date", "amount").withColumnRenamed("amount", "whole")
    out = joins.left_fill(parts, whole, ["huka", "month"], ["whole"])
    return out.select(big("huka").alias("huka"), "doc_type", txt("month").alias("m"), r("amount").alias("amount"), r("whole").alias("whole"))
