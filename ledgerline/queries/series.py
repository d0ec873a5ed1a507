"""Series preparation."""

from pyspark.sql import functions as F

from ..operators import series as O
from ..operators import windows
from ..plans import documents, quarterly
from . import query
from . import roles as R
from .joining import PAIRS
from .roles import big, r, rs, txt
from .windowing import PAY_MONTHS, pay_months


@query("i01_densify", sql=f"""
WITH {PAY_MONTHS} SELECT CAST(huka AS BIGINT) AS huka, CAST(expediture_type AS BIGINT) AS expediture_type, CAST(fc3 AS BIGINT) AS fc3, doc_type, CAST(m AS VARCHAR) AS m, {rs('v')} AS v FROM ps""")
def _(spark, d):
    return pay_months(spark, d).select(*[big(k).alias(k) for k in R.KEYS[:3]], "doc_type", txt("month").alias("m"), r("amount").alias("v"))


@query("i02_extend_to_known_end", sql=f"""
WITH {R.PAYMENTS}, x AS (SELECT huka, fc3, MIN(last_day(payment_date)) AS a, GREATEST(MAX(last_day(payment_date)), DATE '2002-12-31') AS b, SUM(amount) AS v FROM payments GROUP BY 1, 2)
SELECT CAST(huka AS BIGINT) AS huka, CAST(fc3 AS BIGINT) AS fc3, CAST(b AS VARCHAR) AS last, CAST((YEAR(b) - YEAR(a)) * 12 + MONTH(b) - MONTH(a) + 1 AS BIGINT) AS months, {rs('v')} AS total FROM x""")
def _(spark, d):
    from ..functions.arrays import total
    a = O.as_arrays(R.payments(spark, d), ["huka", "fc3"], "payment_date", "amount", known_to="2002-12-31")
    return a.select(big("huka").alias("huka"), big("fc3").alias("fc3"), txt("last_month").alias("last"), big(F.size("values")).alias("months"), r(total(F.col("values"))).alias("total"))


@query("i03_fill_common_span", sql=f"""
WITH {PAIRS}, m AS (SELECT class_out, class_in, last_day(make_date(year, month, 1)) AS m, SUM(value) AS v FROM pairs GROUP BY 1, 2, 3), b AS (SELECT MIN(m) AS a, MAX(m) AS z FROM m), k AS (SELECT DISTINCT class_out, class_in FROM m),
g AS (SELECT class_out, class_in, last_day(CAST(t AS DATE)) AS m FROM k, b, UNNEST(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH)) u(t))
SELECT class_out, class_in, CAST(m AS VARCHAR) AS m, {rs('COALESCE(v, 0)')} AS v FROM g LEFT JOIN m USING (class_out, class_in, m)""")
def _(spark, d):
    x = quarterly.pair_series(quarterly.change_pairs(R.change_lines(spark, d)))
    return x.select("class_out", "class_in", txt("month").alias("m"), r("value").alias("v"))


@query("i04_horizon_months", sql=f"""
WITH {R.BRAND}, e AS (SELECT k, MAX(m) AS b FROM s GROUP BY 1), g AS (SELECT k, b, last_day(CAST(t AS DATE)) AS m FROM e, UNNEST(generate_series(CAST(date_trunc('month', b) + INTERVAL 1 MONTH AS TIMESTAMP), TIMESTAMP '2002-12-31', INTERVAL 1 MONTH)) u(t))
SELECT k, CAST(ROW_NUMBER() OVER (PARTITION BY k ORDER BY m) AS BIGINT) AS step, CAST(m AS VARCHAR) AS m FROM g""")
def _(spark, d):
    return O.horizon(R.brand_arrays(spark, d), ["k"], 2002).select("k", big("step").alias("step"), txt("month").alias("m"))


ELIGIBLE = f"""{PAY_MONTHS}, st AS (SELECT {'huka, expediture_type, fc3, doc_type'}, COUNT(*) AS n, MAX(m) AS b, COUNT(CASE WHEN v > 0 THEN 1 END) AS pos FROM ps GROUP BY ALL),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY huka, expediture_type, fc3, doc_type ORDER BY m DESC) AS rn FROM ps), tl AS (SELECT huka, expediture_type, fc3, doc_type, SUM(v) AS t FROM rk WHERE rn <= 24 GROUP BY ALL)"""


@query("i05_eligibility", sql=f"""
WITH {ELIGIBLE} SELECT doc_type, CAST(COUNT(*) AS BIGINT) AS series, CAST(SUM(CASE WHEN n < 24 OR t = 0 OR YEAR(b) < 2001 THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM st JOIN tl USING (huka, expediture_type, fc3, doc_type) GROUP BY 1""")
def _(spark, d):
    a = O.eligibility(O.as_arrays(R.payments(spark, d), R.KEYS, "payment_date", "amount"), 2002)
    return a.groupBy("doc_type").agg(F.count("*").alias("series"), big(F.sum(F.col("is_bad").cast("int"))).alias("bad"))


@query("i06_sparse_series", sql=f"""
WITH {ELIGIBLE} SELECT doc_type, CAST(SUM(CASE WHEN pos < 12 THEN 1 ELSE 0 END) AS BIGINT) AS sparse FROM st GROUP BY 1""")
def _(spark, d):
    a = O.sparse(O.as_arrays(R.payments(spark, d), R.KEYS, "payment_date", "amount"))
    return a.groupBy("doc_type").agg(big(F.sum(F.col("is_sparse").cast("int"))).alias("sparse"))


@query("i07_holdout_split", sql=f"""
WITH {R.BRAND} SELECT k, CASE WHEN i > n - 12 THEN 'test' ELSE 'train' END AS part, CAST(COUNT(*) AS BIGINT) AS months, {rs('SUM(v)')} AS v FROM s GROUP BY 1, 2""")
def _(spark, d):
    x = windows.split_holdout(R.brand_months(spark, d), ["k"], "m")
    return x.groupBy("k", "part").agg(F.count("*").alias("months"), r(F.sum("v")).alias("v"))


@query("i08_actual_and_forecast", sql=f"""
WITH {R.BRAND}, f AS (SELECT k, AVG(v) AS level, MAX(m) AS b FROM s GROUP BY 1)
SELECT k, 'actual' AS origin, CAST(m AS VARCHAR) AS m, {rs('v', 3)} AS v FROM s
UNION ALL SELECT k, 'forecast', CAST(last_day(CAST(b + INTERVAL (h) MONTH AS DATE)) AS VARCHAR), {rs('level', 3)} FROM f, UNNEST(generate_series(1, 2)) t(h)""")
def _(spark, d):
    from ..forecast.models import forecast
    ahead = forecast(R.brand_arrays(spark, d), ["k"], "mean", 2).select("k", F.col("month").alias("m"), F.col("value").alias("v"))
    return O.stitch(R.brand_months(spark, d), ahead).select("k", "origin", txt("m").alias("m"), r("v", 3).alias("v"))


@query("i09_min_max_scale", sql=f"""
WITH {R.BRAND}, b AS (SELECT k, MIN(v) AS low, MAX(v) AS high FROM s GROUP BY 1)
SELECT s.k, CAST(m AS VARCHAR) AS m, {rs('(v - low) / (high - low)', 7)} AS scaled, {rs('v')} AS back FROM s JOIN b ON s.k = b.k""")
def _(spark, d):
    x = O.min_max_scale(R.brand_months(spark, d), ["k"], "v")
    return x.select("k", txt("m").alias("m"), r("scaled", 7).alias("scaled"), r(O.unscale("scaled")).alias("back"))


@query("i10_year_pairs", sql=f"""
WITH {R.BRAND}, y AS (SELECT k, YEAR(m) AS year, LIST(v ORDER BY m) AS vs, COUNT(*) AS c FROM s GROUP BY 1, 2)
SELECT a.k, CAST(a.year AS BIGINT) AS year, CAST(p AS BIGINT) AS position, {rs('list_concat(b.vs, a.vs)[p]')} AS input, {rs('list_concat(b.vs, a.vs)[p + 1]')} AS target
FROM y a JOIN y b ON a.k = b.k AND b.year = a.year - 1, UNNEST(generate_series(1, 23)) t(p) WHERE a.c = 12 AND b.c = 12""")
def _(spark, d):
    pairs = O.year_pairs(R.brand_months(spark, d), ["k"], "m", "v")
    both = F.posexplode(F.arrays_zip("input", "target")).alias("_p", "_z")
    return pairs.select("k", "year", both).select(
        "k", big("year").alias("year"), big(F.col("_p") + 1).alias("position"), r("_z.input").alias("input"), r("_z.target").alias("target"))
