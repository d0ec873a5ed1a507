"""Spend reports."""

from pyspark.sql import functions as F

from ..operators import ranking
from ..plans import spend
from . import query
from . import roles as R
from .joining import COMBINED, OVER, combined
from .roles import big, r, rs, txt


@query("m01_expenditure_by_year", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(budget_year AS BIGINT) AS budget_year, {', '.join(f"{rs(f'SUM(CASE WHEN expediture_type = {t} THEN amount ELSE 0 END)')} AS type_{t}" for t in (10, 20, 45))} FROM payments GROUP BY 1""")
def _(spark, d):
    x = spend.expenditure_by_year(R.payments(spark, d), [10, 20, 45])
    return x.select(big("budget_year").alias("budget_year"), *[r(f"type_{t}").alias(f"type_{t}") for t in (10, 20, 45)])


_VS = """, pv AS (SELECT huka, order_id, payment_year AS year, SUM(amount) AS amount FROM payments WHERE order_id <> '#' GROUP BY 1, 2, 3), ov AS (SELECT order_id, budget_year AS year, SUM(sales_order_sum) AS s FROM sales GROUP BY 1, 2),
by_year AS (SELECT huka, year, SUM(amount) AS amount, SUM(COALESCE(s, 0)) AS ordered FROM pv LEFT JOIN ov USING (order_id, year) GROUP BY 1, 2), big AS (SELECT * FROM by_year WHERE amount > 1000000), top AS (SELECT huka FROM big GROUP BY 1 ORDER BY SUM(amount) DESC, 1 LIMIT 4)"""


@query("m02_payments_vs_orders", sql=f"""
WITH {R.PAYMENTS}, {R.SALES}{_VS} SELECT CAST(huka AS BIGINT) AS huka, CAST(year AS BIGINT) AS year, {rs('amount')} AS amount, {rs('ordered')} AS ordered FROM big WHERE huka IN (SELECT huka FROM top)""")
def _(spark, d):
    x = spend.payments_vs_orders(R.payments(spark, d), R.sales(spark, d), "huka", 4, 1e6)
    return x.select(big("huka").alias("huka"), big("year").alias("year"), r("amount").alias("amount"), r("sales_order_sum").alias("ordered"))


@query("m02_register_split_top", sql=f"""
WITH {R.PAYMENTS}, t AS (SELECT zroa, budget_year, SUM(CASE WHEN order_id <> '#' THEN amount ELSE 0 END) AS a, SUM(CASE WHEN order_id = '#' THEN amount ELSE 0 END) AS b, COUNT(CASE WHEN order_id <> '#' THEN 1 END) AS na, COUNT(CASE WHEN order_id = '#' THEN 1 END) AS nb FROM payments GROUP BY 1, 2),
f AS (SELECT *, a + b AS total FROM t WHERE na > 0 AND nb > 0 AND a + b > 1000000), top AS (SELECT zroa FROM f GROUP BY 1 ORDER BY SUM(total) DESC, 1 LIMIT 3)
SELECT CAST(zroa AS BIGINT) AS zroa, CAST(budget_year AS BIGINT) AS budget_year, {rs('a')} AS on_register, {rs('b')} AS off_register FROM f WHERE zroa IN (SELECT zroa FROM top)""")
def _(spark, d):
    x = spend.register_split_top(R.payments(spark, d), "zroa", 3, 1e6)
    return x.select(big("zroa").alias("zroa"), big("budget_year").alias("budget_year"), r("on_register").alias("on_register"), r("off_register").alias("off_register"))


@query("m03_early_payments_by_year", sql=f"""
WITH {R.PAYMENTS}, e AS (SELECT * FROM payments WHERE payment_year < budget_year)
SELECT CAST(budget_year AS BIGINT) AS budget_year, {rs("SUM(CASE WHEN order_id <> '#' THEN amount ELSE 0 END)")} AS on_register, {rs("SUM(CASE WHEN order_id = '#' THEN amount ELSE 0 END)")} AS off_register
FROM e GROUP BY 1 HAVING COUNT(CASE WHEN order_id <> '#' THEN 1 END) > 0 AND COUNT(CASE WHEN order_id = '#' THEN 1 END) > 0""")
def _(spark, d):
    x = spend.early_by_year(R.payments(spark, d))
    return x.select(big("budget_year").alias("budget_year"), r("on_register").alias("on_register"), r("off_register").alias("off_register"))


@query("m04_early_payment_orders", sql=f"""
WITH {R.PAYMENTS} SELECT order_id, CAST(payment_date AS VARCHAR) AS payment_date, {rs('amount')} AS amount FROM payments WHERE budget_year = 1999 AND payment_year = 1998 AND order_id <> '#'""")
def _(spark, d):
    x = spend.early_orders(R.payments(spark, d), 1999, 1998)
    return x.select("order_id", txt("payment_date").alias("payment_date"), r("amount").alias("amount"))


@query("m05_backlog_without_overruns", sql=f"""
WITH {OVER}, p AS (SELECT payment_year AS year, SUM(amount) AS amount FROM payments WHERE order_id <> '#' AND order_id NOT IN (SELECT order_id FROM over_orders) GROUP BY 1), o AS (SELECT budget_year AS year, SUM(sales_order_sum) AS s FROM sales WHERE order_id NOT IN (SELECT order_id FROM over_orders) GROUP BY 1)
SELECT CAST(year AS BIGINT) AS year, {rs('COALESCE(amount, 0)')} AS amount, {rs('COALESCE(s, 0)')} AS ordered FROM p FULL JOIN o USING (year)""")
def _(spark, d):
    x = spend.order_backlog(R.payments(spark, d), R.sales(spark, d))
    return x.select(big("year").alias("year"), r("amount").alias("amount"), r("sales_order_sum").alias("ordered"))


@query("m06_paid_by_order_age", sql=f"""
WITH {R.PAYMENTS}, {R.SALES}, o AS (SELECT order_id, SUM(sales_order_sum) AS s, MIN(YEAR(starting_date)) AS y FROM sales WHERE 2001 - YEAR(starting_date) >= 2 GROUP BY 1),
x AS (SELECT order_id, SUM(CASE WHEN payment_year - y = 1 THEN amount * 100 / s END) AS a, SUM(CASE WHEN payment_year - y = 2 THEN amount * 100 / s END) AS b FROM payments JOIN o USING (order_id) WHERE order_id <> '#' GROUP BY 1)
SELECT order_id, {rs('a', 5)} AS percent_first, {rs('b', 5)} AS percent_second FROM x WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(spark, d):
    x = spend.paid_by_order_age(R.payments(spark, d), R.sales(spark, d), R.CURR_YEAR)
    return x.select("order_id", r("percent_first", 5).alias("percent_first"), r("percent_second", 5).alias("percent_second"))


@query("m07_top_segments", sql=f"""
WITH {R.SALES}, g AS (SELECT inviting_partner, SUM(sales_order_sum) AS v FROM sales WHERE budget_year IN (1998, 1999) GROUP BY 1 HAVING SUM(sales_order_sum) > 0 ORDER BY 2 DESC, 1 LIMIT 15)
SELECT inviting_partner, {rs('v')} AS amount, {rs('100 * v / (SELECT SUM(v) FROM g)', 6)} AS percent FROM g""")
def _(spark, d):
    x = spend.top_segments(R.sales(spark, d), "inviting_partner", "sales_order_sum", [1998, 1999], 15)
    return x.select("inviting_partner", r("sales_order_sum").alias("amount"), r("percent", 6).alias("percent"))


_ACTIVE = """, act AS (SELECT huka FROM combined WHERE year IN (1999, 2000) AND expediture_type IN (20, 45) GROUP BY 1 HAVING SUM(amount) <> 0), ad AS (SELECT * FROM combined WHERE huka IN (SELECT huka FROM act)),
lead AS (SELECT huka FROM ad WHERE year IN (1999, 2000) GROUP BY 1 ORDER BY SUM(amount) DESC, 1 LIMIT 3)"""


@query("m08_top_active_keys", sql=f"""
WITH {COMBINED}{_ACTIVE} SELECT CAST(huka AS BIGINT) AS huka, {rs('SUM(amount)')} AS total, {rs('100 * SUM(amount) / (SELECT SUM(amount) FROM ad)', 6)} AS percent FROM ad WHERE huka IN (SELECT huka FROM lead) GROUP BY 1""")
def _(spark, d):
    x = spend.top_active(combined(spark, d), "huka", "amount", [1999, 2000], 3, kinds=[20, 45])
    return x.select(big("huka").alias("huka"), r("total").alias("total"), r("percent", 6).alias("percent"))


@query("m08_biggest_combinations", sql=f"""
WITH {R.PAYMENTS}, act AS (SELECT huka FROM payments WHERE payment_year IN (1999, 2000) GROUP BY 1 HAVING SUM(amount) <> 0), ad AS (SELECT * FROM payments WHERE huka IN (SELECT huka FROM act) AND payment_year IN (1999, 2000))
SELECT CAST(huka AS BIGINT) AS huka, CAST(expediture_type AS BIGINT) AS expediture_type, CAST(fc3 AS BIGINT) AS fc3, doc_type, {rs('SUM(amount)')} AS amount, {rs('100 * SUM(amount) / (SELECT SUM(amount) FROM ad)', 6)} AS percent FROM ad GROUP BY 1, 2, 3, 4 ORDER BY SUM(amount) DESC, 1, 2, 3, 4 LIMIT 10""")
def _(spark, d):
    x = spend.biggest_combinations(R.payments(spark, d), combined(spark, d), R.KEYS, [1999, 2000], 10)
    return x.select(*[big(k).alias(k) for k in R.KEYS[:3]], "doc_type", r("amount").alias("amount"), r("percent", 6).alias("percent"))


@query("m09_key_years", sql=f"""
WITH {COMBINED} SELECT CAST(huka AS BIGINT) AS huka, CAST(year AS BIGINT) AS year, {rs("SUM(CASE WHEN order_id <> '#' THEN amount ELSE 0 END)")} AS on_register, {rs("SUM(CASE WHEN order_id = '#' THEN amount ELSE 0 END)")} AS off_register, {rs('SUM(sales_order_sum)')} AS ordered FROM combined GROUP BY 1, 2""")
def _(spark, d):
    x = spend.key_years(combined(spark, d), "huka")
    return x.select(big("huka").alias("huka"), big("year").alias("year"), r("on_register").alias("on_register"), r("off_register").alias("off_register"), r("sales_order_sum").alias("ordered"))


@query("m10_key_detail_by_doc_type", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(payment_year AS BIGINT) AS year, {', '.join(f"{rs(f'SUM(CASE WHEN doc_type = {t!r} THEN amount ELSE 0 END)')} AS doc_type_{t}" for t in ('RV', 'DR', 'ZW'))} FROM payments WHERE huka = 5002 GROUP BY 1""")
def _(spark, d):
    x = spend.key_detail(R.payments(spark, d), "huka", 5002, "doc_type", ["RV", "DR", "ZW"])
    return x.select(big("payment_year").alias("year"), *[r(f"doc_type_{t}").alias(f"doc_type_{t}") for t in ("RV", "DR", "ZW")])


@query("m10_key_expenditure_share", sql=f"""
WITH {R.PAYMENTS}, g AS (SELECT huka, expediture_type, SUM(amount) AS v FROM payments GROUP BY 1, 2) SELECT CAST(huka AS BIGINT) AS huka, CAST(expediture_type AS BIGINT) AS expediture_type, {rs('v')} AS amount, {rs('100 * v / SUM(v) OVER (PARTITION BY huka)', 6)} AS percent FROM g""")
def _(spark, d):
    x = spend.key_expenditure_share(R.payments(spark, d), "huka")
    return x.select(big("huka").alias("huka"), big("expediture_type").alias("expediture_type"), r("amount").alias("amount"), r("percent", 6).alias("percent"))


@query("m11_parent_children", sql=f"""
WITH {R.PAYMENTS}, g AS (SELECT huka, fc3, SUM(amount) AS v FROM payments GROUP BY 1, 2), p AS (SELECT huka, SUM(v) AS pv FROM g GROUP BY 1 HAVING SUM(v) >= 1000000)
SELECT CAST(huka AS BIGINT) AS huka, CAST(fc3 AS BIGINT) AS fc3, {rs('v')} AS amount, {rs('pv')} AS parent_amount FROM g JOIN p USING (huka) WHERE v >= 1000000""")
def _(spark, d):
    x = spend.parent_children(R.payments(spark, d), "huka", "fc3", 1e6)
    return x.select(big("huka").alias("huka"), big("fc3").alias("fc3"), r("amount").alias("amount"), r("parent_amount").alias("parent_amount"))
