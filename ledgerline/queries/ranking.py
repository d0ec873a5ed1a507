"""Sorting, limits and top-N."""

from pyspark.sql import functions as F

from ..operators import ranking, windows
from . import query
from . import roles as R
from .roles import big, r, rs, txt


@query("g01_order_by_keys", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(huka AS BIGINT) AS huka, CAST(payment_year AS BIGINT) AS year, {rs('SUM(amount)')} AS amount FROM payments GROUP BY 1, 2 ORDER BY 1, 2""")
def _(spark, d):
    x = R.payments(spark, d).groupBy(big("huka").alias("huka"), big("payment_year").alias("year")).agg(r(F.sum("amount")).alias("amount"))
    return x.orderBy("huka", "year")


@query("g02_rows_of_top_keys", sql=f"""
WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY SUM(l_extendedprice) DESC, 1 LIMIT 7)
SELECT l_suppkey, CAST(YEAR(l_shipdate) AS BIGINT) AS year, {rs('SUM(l_extendedprice)')} AS amount FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM top) GROUP BY 1, 2""")
def _(spark, d):
    rows = ranking.rows_of_top_keys(R.table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 7)
    return rows.groupBy("l_suppkey", big(F.year("l_shipdate")).alias("year")).agg(r(F.sum("l_extendedprice")).alias("amount"))


@query("g03_top_combinations", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(huka AS BIGINT) AS huka, CAST(expediture_type AS BIGINT) AS expediture_type, CAST(fc3 AS BIGINT) AS fc3, doc_type, {rs('SUM(amount)')} AS amount, {rs('100.0 * SUM(amount) / (SELECT SUM(amount) FROM payments)', 6)} AS percent
FROM payments GROUP BY 1, 2, 3, 4 ORDER BY SUM(amount) DESC, 1, 2, 3, 4 LIMIT 20""")
def _(spark, d):
    x = ranking.top_with_share(R.payments(spark, d), R.KEYS, "amount", 20)
    return x.select(*[big(k).alias(k) for k in R.KEYS[:3]], "doc_type", r("amount").alias("amount"), r("percent", 6).alias("percent"))


@query("g04_largest_by_truth", sql=f"WITH {R.TRUTH} SELECT k, {rs('actual')} AS actual FROM truth ORDER BY truth.actual DESC, k LIMIT 30")
def _(spark, d):
    return ranking.largest(R.truth(spark, d), "actual", 30, ["k"]).select("k", r("actual").alias("actual"))


@query("g05_head_of_year", sql=f"""
WITH {R.BRAND} SELECT k, {rs('SUM(v)')} AS v FROM s WHERE YEAR(m) = 2001 AND MONTH(m) <= 6 GROUP BY 1""")
def _(spark, d):
    x = R.brand_months(spark, d).where((F.year("m") == 2001) & (F.month("m") <= 6))
    return x.groupBy("k").agg(r(F.sum("v")).alias("v"))


@query("g06_trailing_months", sql=f"""
WITH {R.BRAND} SELECT k, CAST(MIN(m) AS VARCHAR) AS first, {rs('SUM(v)')} AS v FROM s WHERE i > n - 18 GROUP BY 1""")
def _(spark, d):
    x = windows.trailing(R.brand_months(spark, d), ["k"], "m", 18)
    return x.groupBy("k").agg(txt(F.min("m")).alias("first"), r(F.sum("v")).alias("v"))
