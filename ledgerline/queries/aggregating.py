"""Aggregations."""

from pyspark.sql import functions as F

from .. import KEY
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import ranking, windows
from ..plans import po, quarterly, spend
from ..session import cut_lineage
from . import query
from . import roles as R
from .joining import HISTORY, PAIRS, history
from .roles import big, r, rs, txt


@query("e01_consolidate", sql=f"""
SELECT l_orderkey, ARG_MIN(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS flag, MIN(l_shipdate) IS NULL AS undated, {rs('SUM(l_extendedprice)')} AS amount FROM lineitem GROUP BY 1""")
def _(spark, d):
    line = R.table(spark, d, "lineitem")
    out = A.consolidate(line, ["l_orderkey"], ["l_returnflag", "l_shipdate"], "l_extendedprice", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_shipdate").isNull().alias("undated"), r("l_extendedprice").alias("amount"))


@query("e02_past_sums_this_year", sql=f"""
WITH {R.PO_INVOICES} SELECT doc_id, {rs('SUM(RE + ZY + ZF)')} AS past_sum FROM po_invoices WHERE invoice_year = 2001 AND invoice_month <= 10 GROUP BY 1""")
def _(spark, d):
    past = A.past_sums(po.prepare_invoices(R.po_invoices(spark, d)), KEY, po.VOLUMES, R.CURR_YEAR, R.CURR_MONTH)
    return past.select("doc_id", r("past_sum").alias("past_sum"))


@query("e03_sum_by_relative_month", sql=f"""
WITH {HISTORY} SELECT CAST(rel_month AS BIGINT) AS rel_month, CAST(COUNT(*) AS BIGINT) AS cells, {rs('SUM(volume)')} AS volume FROM history GROUP BY 1""")
def _(spark, d):
    past = history(spark, d)[1]
    return past.groupBy(big("rel_month").alias("rel_month")).agg(F.count("*").alias("cells"), r(F.sum("volume")).alias("volume"))


@query("e04_unique_key_sum", sql=f"""
WITH {R.DOC_INVOICES} SELECT doc, grp, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, {rs('SUM(volume)')} AS volume FROM doc_invoices GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return A.collapse(R.doc_invoices(spark, d), "volume").select(
        "doc", F.col("group").alias("grp"), big("year").alias("year"), big("month").alias("month"), r("volume").alias("volume"))


@query("e05_melt_months", sql=f"""
WITH {R.BUDGET}, ids AS (SELECT DISTINCT financial_year, economy, expenditure_type, doc_type, fund_code, fingroup, law FROM budget),
cells AS (SELECT financial_year, m, COUNT(*) AS cells FROM ids, UNNEST(generate_series(1, 12)) t(m) GROUP BY 1, 2),
sums AS (SELECT financial_year, month_no AS m, SUM(volume) AS volume FROM budget GROUP BY 1, 2)
SELECT CAST(financial_year AS BIGINT) AS financial_year, CAST(m AS VARCHAR) AS month_no, CAST(cells AS BIGINT) AS cells, {rs('COALESCE(volume, 0)')} AS volume FROM cells LEFT JOIN sums USING (financial_year, m)""")
def _(spark, d):
    long = A.melt(R.budget_wide(spark, d), quarterly.BUDGET_IDS, quarterly.MONTH_COLUMNS, "month_no", "volume")
    return long.groupBy(big("financial_year").alias("financial_year"), "month_no").agg(
        F.count("*").alias("cells"), r(F.sum(S.parse_amount("volume"))).alias("volume"))


def _cases(column, labels, measure, prefix=""):
    return ", ".join(f"{rs(f'SUM(CASE WHEN {column} = {label!r} THEN {measure} ELSE 0 END)')} AS \"{prefix}{label}\"" for label in labels)


@query("e06_pivot_sum", sql=f"""
SELECT CAST(YEAR(l_shipdate) AS BIGINT) AS year, {_cases('l_returnflag', ['A', 'N', 'R'], 'l_extendedprice')} FROM lineitem GROUP BY 1""")
def _(spark, d):
    line = R.table(spark, d, "lineitem").withColumn("year", big(F.year("l_shipdate")))
    wide = A.pivot_sum(line, ["year"], "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    return wide.select("year", *[r(c).alias(c) for c in "ANR"])


@query("e07_groups_above_threshold", sql=f"""
WITH y AS (SELECT l_suppkey, YEAR(l_shipdate) AS year, SUM(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
keep AS (SELECT l_suppkey FROM y GROUP BY 1 HAVING AVG(ABS(v)) > (SELECT AVG(v) FROM y))
SELECT l_suppkey, CAST(COUNT(*) AS BIGINT) AS lines, {rs('SUM(l_extendedprice)')} AS amount FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM keep) GROUP BY 1""")
def _(spark, d):
    line = R.table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    usual = A.sum_by(line, ["l_suppkey", "year"], "l_extendedprice").agg(F.avg("l_extendedprice")).scalar()
    kept = A.keep_groups_above(line, ["l_suppkey"], "year", "l_extendedprice", usual)
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("lines"), r(F.sum("l_extendedprice")).alias("amount"))


@query("e08_full_years", sql=f"""
WITH {R.BRAND}, full_years AS (SELECT k, YEAR(m) AS y FROM s GROUP BY 1, 2 HAVING COUNT(DISTINCT MONTH(m)) = 12)
SELECT s.k, CAST(YEAR(s.m) AS BIGINT) AS year, {rs('SUM(v)')} AS v FROM s JOIN full_years f ON f.k = s.k AND f.y = YEAR(s.m) GROUP BY 1, 2""")
def _(spark, d):
    months = R.brand_months(spark, d).withColumns({"year": big(F.year("m")), "month_no": F.month("m")})
    return A.full_years(months, ["k"], "year", "month_no").groupBy("k", "year").agg(r(F.sum("v")).alias("v"))


@query("e09_total_by_group", sql=f"""
WITH {R.PO_ORDERS} SELECT fingroup, {rs('SUM(po_net_value)')} AS value FROM po_orders GROUP BY 1""")
def _(spark, d):
    o = po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d))
    return A.sum_by(o, ["fingroup"], "po_net_value").select("fingroup", r("po_net_value").alias("value"))


@query("e10_net_by_side", sql=f"""
WITH {PAIRS} SELECT 'out' AS side, class_out AS party, CAST(year AS BIGINT) AS year, {rs('SUM(value)')} AS net FROM pairs GROUP BY 2, 3
UNION ALL SELECT 'in', class_in, CAST(year AS BIGINT), {rs('-SUM(value)')} FROM pairs GROUP BY 2, 3""")
def _(spark, d):
    pairs = quarterly.change_pairs(R.change_lines(spark, d))
    net = A.net_by_side(pairs, "class_out", "class_in", "value", ["year"])
    return net.select("side", "party", big("year").alias("year"), r("net").alias("net"))


@query("e11_annual_report", sql=f"""
SELECT p_brand AS k, {_cases('l_returnflag', ['A', 'N', 'R'], 'l_extendedprice')}, {rs('SUM(l_extendedprice)')} AS sum FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(spark, d):
    line, part = R.table(spark, d, "lineitem"), R.table(spark, d, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey).withColumnRenamed("p_brand", "k")
    report = A.annual_report(rows, "k", "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    return report.select("k", *[r(c).alias(c) for c in ("A", "N", "R", "sum")])


@query("e12_monthly_and_yearly_sums", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(huka AS BIGINT) AS huka, CAST(payment_year AS BIGINT) AS year, CAST(COUNT(DISTINCT payment_month) AS BIGINT) AS months, {rs('SUM(amount)')} AS amount FROM payments GROUP BY 1, 2""")
def _(spark, d):
    months = A.monthly(R.payments(spark, d), ["huka"], "payment_date", "amount")
    years = A.yearly(months, ["huka"], "month", "amount")
    counts = months.groupBy("huka", F.year("month").alias("year")).agg(F.count("*").alias("months"))
    return years.join(counts, ["huka", "year"]).select(big("huka").alias("huka"), big("year").alias("year"), "months", r("amount").alias("amount"))


@query("e13_zero_cells", sql=f"""
WITH {PAIRS}, labels AS (SELECT DISTINCT class_in FROM pairs), rows AS (SELECT DISTINCT class_out, year, month FROM pairs),
cells AS (SELECT rows.*, labels.class_in, COALESCE((SELECT SUM(value) FROM pairs p WHERE p.class_out = rows.class_out AND p.year = rows.year AND p.month = rows.month AND p.class_in = labels.class_in), 0) AS v FROM rows, labels)
SELECT class_out, class_in, CAST(COUNT(CASE WHEN v = 0 THEN 1 END) AS BIGINT) AS zeros FROM cells GROUP BY 1, 2""")
def _(spark, d):
    """Zero cells of every pair of classes in the matrix of months; all labels of the table are columns."""
    pairs = cut_lineage(quarterly.change_pairs(R.change_lines(spark, d)))
    labels = sorted(row["class_in"] for row in pairs.select("class_in").distinct().collect())  # the columns of the matrix
    cells = A.pivot_sum(pairs, ["class_out", "year", "month"], "class_in", labels, "value")
    for label in labels:
        cells = A.zero_cells(cells, label)
    counted = cells.groupBy("class_out").agg(*[F.count(label).alias(label) for label in labels])
    return A.melt(counted, ["class_out"], labels, "class_in", "zeros")


@query("e14_share_of_total", sql=f"""
SELECT l_returnflag, l_linestatus, {rs('100.0 * SUM(l_extendedprice) / (SELECT SUM(l_extendedprice) FROM lineitem)', 6)} AS percent FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    totals = A.sum_by(R.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return A.with_share(totals, "l_extendedprice", "percent", 100.0).select("l_returnflag", "l_linestatus", r("percent", 6).alias("percent"))


@query("e15_row_percentages", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(budget_year AS BIGINT) AS budget_year, {', '.join(f"{rs(f'100.0 * SUM(CASE WHEN payment_year = {y} THEN amount ELSE 0 END) / SUM(amount)', 6)} AS c{y}" for y in R.PAYMENT_YEARS)}
FROM payments WHERE order_id <> '#' GROUP BY 1""")
def _(spark, d):
    m = spend.payment_year_matrix(spend.registered(R.payments(spark, d)), R.PAYMENT_YEARS)
    return m.select(big("budget_year").alias("budget_year"), *[r(f"c{y}", 6).alias(f"c{y}") for y in R.PAYMENT_YEARS])


@query("e16_register_split", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(budget_year AS BIGINT) AS budget_year, {rs("SUM(CASE WHEN order_id <> '#' THEN amount ELSE 0 END)")} AS on_register, {rs("SUM(CASE WHEN order_id = '#' THEN amount ELSE 0 END)")} AS off_register FROM payments GROUP BY 1""")
def _(spark, d):
    s = A.split_by_register(R.payments(spark, d), ["budget_year"], "amount")
    return s.select(big("budget_year").alias("budget_year"), r("on_register").alias("on_register"), r("off_register").alias("off_register"))


@query("e17_top_and_other", sql=f"""
WITH {R.PAYMENTS}, s AS (SELECT CAST(fc4 AS VARCHAR) AS fc4, ABS(SUM(amount)) AS size FROM payments GROUP BY 1), n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY size DESC, fc4) AS rn FROM s)
SELECT CASE WHEN rn <= 8 THEN fc4 ELSE 'Other' END AS fc4, {rs('SUM(size)')} AS size FROM n GROUP BY 1""")
def _(spark, d):
    return ranking.top_and_other(R.payments(spark, d), "fc4", "amount", 8).select("fc4", r("size").alias("size"))


@query("e18_children_of_parent", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(zroa AS BIGINT) AS zroa, CAST(fc4 AS BIGINT) AS fc4, {rs('SUM(amount)')} AS amount FROM payments GROUP BY 1, 2 HAVING SUM(amount) >= 10000000""")
def _(spark, d):
    out = A.children_of(R.payments(spark, d), "zroa", "fc4", "amount", 1e7)
    return out.select(big("zroa").alias("zroa"), big("fc4").alias("fc4"), r("amount").alias("amount"))


@query("e19_describe_series", sql=f"""
WITH {R.BRAND} SELECT k, CAST(COUNT(v) AS BIGINT) AS count, {rs('AVG(v)', 3)} AS mean, {rs('STDDEV_SAMP(v)', 3)} AS std, {rs('MIN(v)')} AS min, {rs('QUANTILE_CONT(v, 0.25)', 3)} AS q25, {rs('QUANTILE_CONT(v, 0.5)', 3)} AS q50,
  {rs('QUANTILE_CONT(v, 0.75)', 3)} AS q75, {rs('MAX(v)')} AS max, {rs('AVG(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END)', 6)} AS zero_share, {rs('STDDEV_SAMP(v) / AVG(v)', 6)} AS cv FROM s GROUP BY 1""")
def _(spark, d):
    t = A.describe(R.brand_months(spark, d), ["k"], "v")
    digits = {"mean": 3, "std": 3, "min": 2, "q25": 3, "q50": 3, "q75": 3, "max": 2, "zero_share": 6, "cv": 6}
    return t.select("k", "count", *[r(c, n).alias(c) for c, n in digits.items()])


@query("e20_log_histogram", sql=f"""
WITH {R.PAYMENTS}, x AS (SELECT SIGN(amount) * LN(ABS(amount)) AS x FROM payments), b AS (SELECT MIN(x) AS a, MAX(x) AS z, COUNT(*) AS n FROM x)
SELECT CAST(LEAST(50, FLOOR((x - a) / ((z - a) / 50.0)) + 1) AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS count, {rs('COUNT(*) / (MIN(n) * (MIN(z - a) / 50.0))', 8)} AS density FROM x, b GROUP BY 1""")
def _(spark, d):
    h = A.histogram(R.payments(spark, d), S.signed_log("amount"))
    return h.select(big("bin").alias("bin"), "count", r("density", 8).alias("density"))


@query("e21_value_counts", sql="""
SELECT o_orderdate::DATE::VARCHAR AS day, CAST(COUNT(*) AS BIGINT) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(spark, d):
    days = R.table(spark, d, "orders").select(txt(F.col("o_orderdate").cast("date")).alias("day"))
    return A.value_counts(days, "day")


@query("e22_distinct_and_moments", sql=f"""
WITH {R.BRAND} SELECT k, CAST(COUNT(DISTINCT YEAR(m)) AS BIGINT) AS years, {rs('MIN(v)')} AS low, {rs('MAX(v)')} AS high, {rs('MEDIAN(v)', 3)} AS median, {rs('VAR_SAMP(v)', 0)} AS variance FROM s GROUP BY 1""")
def _(spark, d):
    return R.brand_months(spark, d).groupBy("k").agg(
        F.countDistinct(F.year("m")).alias("years"), r(F.min("v")).alias("low"), r(F.max("v")).alias("high"),
        r(F.percentile("v", F.lit(0.5)), 3).alias("median"), r(F.var_samp("v"), 0).alias("variance"))


def _by_feature(feature):
    def run(spark, d):
        return A.sum_by(R.payments(spark, d), [feature], "amount").select(txt(feature).alias("value"), r("amount").alias("amount"))
    query(f"e23_group_by_{feature}", sql=f"WITH {R.PAYMENTS} SELECT CAST({feature} AS VARCHAR) AS value, {rs('SUM(amount)')} AS amount FROM payments GROUP BY 1")(run)


for _feature in ("huka", "zroa", "fc3"):
    _by_feature(_feature)


@query("e24_variance_explained", sql=f"""
WITH {R.BRAND}, t AS (SELECT k, m, v, AVG(v) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS trend, AVG(v) OVER (PARTITION BY k, MONTH(m)) - AVG(v) OVER (PARTITION BY k) AS seasonal FROM s)
SELECT k, {rs('1 - VAR_SAMP(v - trend - seasonal) / VAR_SAMP(v)', 6)} AS explained, {rs('VAR_SAMP(v - trend - seasonal) / VAR_SAMP(v)', 6)} AS resid_share FROM t GROUP BY 1""")
def _(spark, d):
    from pyspark.sql import Window
    months = windows.centered_mean(R.brand_months(spark, d), ["k"], ["m"], "v")
    seasonal = F.avg("v").over(Window.partitionBy("k", F.month("m"))) - F.avg("v").over(Window.partitionBy("k"))
    parts = months.withColumn("seasonal", seasonal).withColumn("resid", F.col("v") - F.col("trend") - F.col("seasonal"))
    out = A.variance_explained(parts, ["k"])
    return out.select("k", r("explained", 6).alias("explained"), r("resid_share", 6).alias("resid_share"))
