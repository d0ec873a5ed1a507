"""Projections, filters, cleaning and scalar functions."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scalars as S
from ..operators import joins
from ..plans import documents, generate, po, quarterly, spend
from ..session import cut_lineage
from . import query
from . import roles as R
from .roles import big, r, rs, txt


@query("c01_parse_amounts", sql=f"""
WITH {R.BUDGET}, cells AS (SELECT financial_year, economy, expenditure_type, doc_type, fund_code, fingroup, law, month_no, SUM(volume) AS v FROM budget GROUP BY ALL)
SELECT doc_type, month_no AS month, {rs('SUM(v)')} AS volume FROM cells GROUP BY 1, 2""")
def _(spark, d):
    long = quarterly.budget_long(R.budget_wide(spark, d))
    return long.groupBy("doc_type", big(F.month("month")).alias("month")).agg(r(F.sum("volume")).alias("volume"))


@query("c02_normalise_keys", sql=f"""
WITH {R.PO_ORDERS} SELECT fund_year, CAST(COUNT(*) AS BIGINT) AS orders, MIN(doc_id) AS first_doc, MAX(item) AS item FROM po_orders GROUP BY 1""")
def _(spark, d):
    return po.prepare_keys(R.po_orders(spark, d)).groupBy("fund_year").agg(
        F.count("*").alias("orders"), F.min("doc_id").alias("first_doc"), F.max("item").alias("item"))


@query("c03_coin_and_budget_year", sql=f"""
WITH {R.SALES} SELECT CAST(budget_year AS BIGINT) AS budget_year, CAST(coin AS BIGINT) AS coin, CAST(COUNT(*) AS BIGINT) AS orders, {rs('SUM(sales_order_sum)')} AS amount
FROM sales GROUP BY 1, 2""")
def _(spark, d):
    return R.sales(spark, d).groupBy(big("budget_year").alias("budget_year"), big("coin").alias("coin")).agg(
        F.count("*").alias("orders"), r(F.sum("sales_order_sum")).alias("amount"))


@query("c04_month_end_stamp", sql=f"""
SELECT CAST(last_day(CAST(l_shipdate AS DATE)) AS VARCHAR) AS month, {rs('SUM(l_extendedprice)')} AS amount FROM lineitem GROUP BY 1""")
def _(spark, d):
    line = R.table(spark, d, "lineitem")
    stamp = S.month_end(F.year("l_shipdate"), F.month("l_shipdate"))
    return line.groupBy(txt(stamp).alias("month")).agg(r(F.sum("l_extendedprice")).alias("amount"))


@query("c05_day_first_dates", sql="""
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, CAST(COUNT(*) AS BIGINT) AS orders FROM orders GROUP BY 1""")
def _(spark, d):
    parsed = R.po_dates(spark, d).select(S.day_first_date("order_date").alias("order_date"))
    return parsed.groupBy(txt("order_date").alias("order_date")).agg(F.count("*").alias("orders"))


@query("c06_serial_day_dates", sql=f"""
WITH {R.RAW_SALES} SELECT CAST(CAST(DATE '1899-12-30' + CAST(order_starting_date AS INTEGER) AS DATE) AS VARCHAR) AS day, CAST(COUNT(*) AS BIGINT) AS orders FROM raw_sales GROUP BY 1""")
def _(spark, d):
    return R.raw_sales(spark, d).groupBy(txt(S.serial_day("order_starting_date")).alias("day")).agg(F.count("*").alias("orders"))


@query("c07_compact_date_parts", sql=f"""
WITH {R.PO_EDITS} SELECT CAST((edit_abs - 1) // 12 AS BIGINT) AS year, CAST((edit_abs - 1) % 12 + 1 AS BIGINT) AS month, {rs('SUM(volume)')} AS volume FROM po_edits GROUP BY 1, 2""")
def _(spark, d):
    return R.po_edits(spark, d).groupBy(
        big(S.compact_year("order_date")).alias("year"), big(S.compact_month("order_date")).alias("month"),
    ).agg(r(F.sum("volume")).alias("volume"))


@query("c08_date_parts", sql="""
SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS year, CAST(QUARTER(o_orderdate) AS BIGINT) AS quarter, CAST(MONTH(o_orderdate) AS BIGINT) AS month, CAST(COUNT(*) AS BIGINT) AS orders FROM orders GROUP BY 1, 2, 3""")
def _(spark, d):
    o = R.table(spark, d, "orders")
    return o.groupBy(
        big(F.year("o_orderdate")).alias("year"), big(F.quarter("o_orderdate")).alias("quarter"), big(F.month("o_orderdate")).alias("month"),
    ).agg(F.count("*").alias("orders"))


@query("c09_relative_month", sql="""
SELECT CAST(GREATEST((YEAR(l_shipdate) - YEAR(o_orderdate)) * 12 + MONTH(l_shipdate) - MONTH(o_orderdate), 0) AS BIGINT) AS rel_month, CAST(COUNT(*) AS BIGINT) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, d):
    line, o = R.table(spark, d, "lineitem"), R.table(spark, d, "orders")
    monthly = line.groupBy("l_orderkey", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.count("*").alias("lines"))
    rel = S.relative_month("y", "m", F.year("o_orderdate"), F.month("o_orderdate"))
    joined = monthly.join(o, monthly.l_orderkey == o.o_orderkey)
    return joined.groupBy(big(rel).alias("rel_month")).agg(F.sum("lines").alias("lines"))


@query("c10_lag_and_age", sql=f"""
WITH {R.PO_ORDERS} SELECT CAST(CAST(fund_year AS INT) - order_year AS BIGINT) AS n, CAST((2001 - order_year) * 12 + 10 - order_month AS BIGINT) AS age, CAST(COUNT(*) AS BIGINT) AS orders
FROM po_orders GROUP BY 1, 2""")
def _(spark, d):
    o = po.with_features(po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d)))
    age = S.months_between_parts(F.lit(R.CURR_YEAR), F.lit(R.CURR_MONTH), "order_year", "order_month")
    return o.groupBy(big("N").alias("n"), big(age).alias("age")).agg(F.count("*").alias("orders"))


@query("c11_membership_and_range_filters", sql=f"""
WITH {R.BUDGET} SELECT doc_type, CAST(fund_code AS BIGINT) AS fund_code, CAST(COUNT(*) AS BIGINT) AS cnt FROM budget
WHERE doc_type NOT IN ('RE', 'ZY', 'ZF', 'ZH') AND fund_code <> 1410 AND fund_code NOT IN (1407, 1405, 1400, 1406) AND financial_year BETWEEN 1996 AND 1999 GROUP BY 1, 2""")
def _(spark, d):
    rows = R.budget_rows(spark, d).where(L.keep_for_labelling(1) & F.col("financial_year").between(1996, 1999))
    return rows.groupBy("doc_type", big("fund_code").alias("fund_code")).agg(F.count("*").alias("cnt"))


@query("c12_fill_drop_and_flip", sql=f"""
WITH {R.PAYMENTS} SELECT doc_type, CAST(COUNT(*) AS BIGINT) AS cnt, {rs('SUM(amount)')} AS amount, {rs('MIN(amount)')} AS low FROM payments GROUP BY 1""")
def _(spark, d):
    return R.payments(spark, d).groupBy("doc_type").agg(
        F.count("*").alias("cnt"), r(F.sum("amount")).alias("amount"), r(F.min("amount")).alias("low"))


@query("c13_old_year_cut", sql=f"""
WITH {R.RAW_PAYMENTS} SELECT CAST(budget_year AS BIGINT) AS budget_year, {rs('SUM(-mimun)')} AS amount FROM raw_payments WHERE COALESCE(mimun, 0) <> 0 AND budget_year > 1997 GROUP BY 1""")
def _(spark, d):
    rows = spend.clean_payments(R.raw_payments(spark, d), 1997)
    return rows.groupBy(big("budget_year").alias("budget_year")).agg(r(F.sum("amount")).alias("amount"))


def _condition(values: dict) -> str:
    return " AND ".join(f"{c} IN ({', '.join(repr(v) for v in vs)})" for c, vs in values.items())


def kept_budget(coin: int) -> str:
    """Labelled budget rows: the highest matching rule number instead of a reversed case chain."""
    rules = L.rules_for(coin)
    ranks = ", ".join(f"CASE WHEN {_condition(c)} THEN {i} ELSE 0 END" for i, (_, c) in enumerate(rules, 1))
    names = [L.DEFAULT_LABEL] + [name for name, _ in rules]
    drop = "AND fund_code NOT IN (1407, 1405, 1400, 1406)" if coin == 1 else ""
    return f"""{R.BUDGET}, kept AS (SELECT *, ({names})[GREATEST({ranks}) + 1] AS type FROM budget
      WHERE doc_type NOT IN ('RE', 'ZY', 'ZF', 'ZH') AND fund_code <> 1410 {drop})"""


def _label_sql(coin: int) -> str:
    return f"""WITH {kept_budget(coin)}
      SELECT type, CAST(COUNT(*) AS BIGINT) AS cnt, {rs('SUM(volume)')} AS volume FROM kept GROUP BY 1"""


def _labelled(coin):
    def run(spark, d):
        rows = quarterly.labelled(R.budget_rows(spark, d), coin)
        return rows.groupBy("type").agg(F.count("*").alias("cnt"), r(F.sum("volume")).alias("volume"))
    return run


query("c14_label_rules_coin_1", sql=_label_sql(1))(_labelled(1))
query("c14_label_rules_coin_5", sql=_label_sql(5))(_labelled(5))


@query("c15_merge_codes", sql=f"""
WITH {R.DOC_FUNDS} SELECT CAST(CASE doc WHEN 51 THEN 50 WHEN 61 THEN 60 ELSE doc END AS VARCHAR) AS doc, {rs('SUM(volume)')} AS volume FROM doc_funds WHERE doc IN (50, 51, 60, 61, 78, 79) GROUP BY 1""")
def _(spark, d):
    return documents.merge_fund_docs(R.doc_funds(spark, d)).groupBy("doc").agg(r(F.sum("volume")).alias("volume"))


@query("c15_merge_invoice_codes", sql=f"""
WITH {R.DOC_INVOICES} SELECT CASE doc WHEN 'ZY' THEN 'RE' WHEN 'ZF' THEN 'RE' WHEN 'KG' THEN 'KR' ELSE doc END AS doc, {rs('SUM(volume)')} AS volume FROM doc_invoices GROUP BY 1""")
def _(spark, d):
    return documents.merge_invoice_docs(R.doc_invoices(spark, d)).groupBy("doc").agg(r(F.sum("volume")).alias("volume"))


@query("c16_exclude_known_rows", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(huka AS BIGINT) AS huka, CAST(COUNT(*) AS BIGINT) AS cnt FROM payments
WHERE NOT (budget_year = 2000 AND coin = 5 AND huka = 5003 AND expediture_type = 10 AND doc_type = 'DR') GROUP BY 1""")
def _(spark, d):
    bad = {"budget_year": 2000, "coin": 5, "huka": 5003, "expediture_type": 10, "doc_type": "DR"}
    kept = spend.except_rows(R.payments(spark, d), bad)
    return kept.groupBy(big("huka").alias("huka")).agg(F.count("*").alias("cnt"))


@query("c17_effective_dates", sql=f"""
WITH {R.DOC_ORDERS} SELECT CAST(CASE WHEN year < fund_year THEN fund_year ELSE year END AS BIGINT) AS year, CAST(CASE WHEN year < fund_year THEN 1 ELSE month END AS BIGINT) AS month, {rs('SUM(volume)')} AS volume
FROM doc_orders GROUP BY 1, 2""")
def _(spark, d):
    rows = documents.effective_dates(R.doc_orders(spark, d))
    return rows.groupBy(big("year").alias("year"), big("month").alias("month")).agg(r(F.sum("volume")).alias("volume"))


@query("c18_clip_to_range", sql=f"""
WITH {R.DOC_ORDERS}, late AS (SELECT doc, year + 1 AS year, month, volume FROM doc_orders),
b AS (SELECT MIN(YEAR(l_shipdate)) AS a, MAX(YEAR(l_shipdate) * 12 + MONTH(l_shipdate)) AS z FROM lineitem)
SELECT doc, CAST(COUNT(*) AS BIGINT) AS cnt, CAST(MAX(year * 12 + month) AS BIGINT) AS last FROM late, b WHERE year >= a AND year * 12 + month <= z GROUP BY 1""")
def _(spark, d):
    late = R.doc_orders(spark, d).withColumn("year", F.col("year") + 1)
    kept = documents.clip_to(late, R.doc_invoices(spark, d))
    return kept.groupBy("doc").agg(F.count("*").alias("cnt"), big(F.max(F.col("year") * 12 + F.col("month"))).alias("last"))


@query("c19_drop_null_rows", sql=f"""
WITH {R.CHANGES}, p AS (SELECT doc_id, MAX(CASE WHEN doc_item = 1 THEN mof_class END) AS a, MAX(CASE WHEN doc_item = 2 THEN mof_class END) AS b FROM changes WHERE fund_code <> 1410 AND doc_item IN (1, 2) GROUP BY 1)
SELECT doc_id, LEAST(a, b) AS first_class, GREATEST(a, b) AS second_class FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(spark, d):
    pairs = quarterly.change_pairs(R.change_lines(spark, d))
    return pairs.select("doc_id", F.least("class_out", "class_in").alias("first_class"), F.greatest("class_out", "class_in").alias("second_class"))


@query("c20_fill_from_other_column", sql=f"""
SELECT CAST(COALESCE(YEAR(l_shipdate), YEAR(o_orderdate)) AS BIGINT) AS year, {rs('SUM(COALESCE(l_extendedprice, 0))')} AS volume
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, d):
    orders = po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d))
    joined = joins.orders_with_invoices(po.prepare_invoices(R.po_invoices(spark, d)), orders, po.KEY, po.VOLUMES)
    total = F.col("RE") + F.col("ZY") + F.col("ZF")
    return joined.groupBy(big("invoice_year").alias("year")).agg(r(F.sum(total)).alias("volume"))


@query("c21_first_per_key", sql="""
WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS rn FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_partkey FROM x WHERE rn = 1""")
def _(spark, d):
    line = R.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey")
    one = joins.first_per_key(line, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"])
    return one.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), txt(F.col("l_shipdate").cast("date")).alias("day"), "l_partkey")


@query("c22_drop_full_duplicates", sql="""
WITH x AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem) SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS cnt FROM x GROUP BY 1, 2""")
def _(spark, d):
    rows = R.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("cnt"))


@query("c23_signed_log", sql=f"""
WITH {R.PAYMENTS} SELECT doc_type, {rs('SUM(SIGN(amount) * LN(ABS(amount)))', 4)} AS total FROM payments GROUP BY 1""")
def _(spark, d):
    return R.payments(spark, d).groupBy("doc_type").agg(r(F.sum(S.signed_log("amount")), 4).alias("total"))


@query("c24_non_finite_to_zero", sql=f"""
SELECT l_returnflag, {rs('SUM(COALESCE(l_extendedprice / NULLIF(l_tax, 0), 0))', 0)} AS ratio FROM lineitem GROUP BY 1""")
def _(spark, d):
    # a division outside ANSI rules: infinite where the tax is zero
    ratio = F.col("l_extendedprice") * F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.nullif("l_tax", F.lit(0.0)))
    return R.table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.sum(S.finite_or(ratio, 0.0)), 0).alias("ratio"))


def _bin_sql(n):
    return f"""WITH x AS (SELECT LN(o_totalprice) AS x FROM orders WHERE o_totalprice > 0), b AS (SELECT MIN(x) AS a, MAX(x) AS z FROM x)
    SELECT CAST(LEAST({n}, GREATEST(1, CEIL((x - a) / ((z - a) / {n}.0)))) AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS cnt FROM x, b GROUP BY 1"""


@query("c25_equal_width_bins_10", sql=_bin_sql(10))
def _(spark, d):
    o = po.with_features(cut_lineage(po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d))))
    return o.groupBy(big("po_net_value_category").alias("bin")).agg(F.count("*").alias("cnt"))


@query("c25_equal_width_bins_100", sql=_bin_sql(100))
def _(spark, d):
    orders = cut_lineage(po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d)))
    return generate.with_value_class(orders).groupBy(big("value_class").alias("bin")).agg(F.count("*").alias("cnt"))


@query("c26_recency_filters", sql=f"""
WITH {R.PO_ORDERS} SELECT fund_year, CAST(COUNT(*) AS BIGINT) AS orders FROM po_orders
WHERE order_year >= 1997 - 2 AND CAST(fund_year AS INT) <= 1997 + 1 AND (1997 - order_year) * 12 + 6 - order_month <= 120 GROUP BY 1""")
def _(spark, d):
    o = po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d))
    age = S.months_between_parts(F.lit(1997), F.lit(6), "order_year", "order_month")
    kept = o.where((F.col("order_year") >= 1997 - 2) & (F.col("fund_year").cast("int") <= 1998) & (age <= po.MAX_AGE))
    return kept.groupBy("fund_year").agg(F.count("*").alias("orders"))


@query("c29_orders_as_of", sql=f"""
WITH {R.PO_ORDERS} SELECT CAST(order_year AS BIGINT) AS order_year, CAST(COUNT(*) AS BIGINT) AS orders, CAST(SUM((2001 * 12 + 10 - order_year * 12 - order_month) // 12) AS BIGINT) AS year_sets FROM po_orders
WHERE order_year < 2000 OR (order_year = 2000 AND order_month <= 10) GROUP BY 1""")
def _(spark, d):
    o = po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d)).select("doc_id", "order_year", "order_month")
    copies = joins.copies_over_ages(o, R.CURR_YEAR, R.CURR_MONTH).where(F.col("age") == 0)
    return copies.groupBy(big("order_year").alias("order_year")).agg(
        big(F.sum(F.when(F.col("years_old") == 1, 1))).alias("orders"), F.count("*").alias("year_sets"))


@query("c30_select_years", sql=f"""
WITH {R.PAYMENTS} SELECT CAST(budget_year AS BIGINT) AS budget_year, {rs('SUM(amount)')} AS amount FROM payments WHERE budget_year IN (1997, 1998, 1999) GROUP BY 1""")
def _(spark, d):
    rows = spend.of_years(R.payments(spark, d), [1997, 1998, 1999])
    return rows.groupBy(big("budget_year").alias("budget_year")).agg(r(F.sum("amount")).alias("amount"))


# --- scalar functions ------------------------------------------------------------------

@query("h01_substrings", sql="""
SELECT SUBSTR(o_orderpriority, 1, 1) AS first, SUBSTR(o_orderpriority, 3, 4) AS word, CAST(COUNT(*) AS BIGINT) AS cnt FROM orders GROUP BY 1, 2""")
def _(spark, d):
    o = R.table(spark, d, "orders")
    return o.groupBy(F.substring("o_orderpriority", 1, 1).alias("first"), F.substring("o_orderpriority", 3, 4).alias("word")).agg(F.count("*").alias("cnt"))


@query("h02_trim_lower_replace", sql="""
SELECT REPLACE(REPLACE(LOWER(TRIM(' ' || o_orderpriority || ' ')), '-', '_'), ' ', '_') AS label, CAST(COUNT(*) AS BIGINT) AS cnt FROM orders GROUP BY 1""")
def _(spark, d):
    padded = F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))
    label = F.regexp_replace(F.lower(F.trim(padded)), "[- ]", "_")
    return R.table(spark, d, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("cnt"))


@query("h03_split_first_last", sql=f"""
WITH {R.TRUTH} SELECT SPLIT_PART(k, '/', 1) AS head, SPLIT_PART(k, '/', -1) AS tail, {rs('SUM(actual)')} AS actual FROM truth GROUP BY 1, 2""")
def _(spark, d):
    t = R.truth(spark, d)
    return t.groupBy(F.split_part("k", F.lit("/"), F.lit(1)).alias("head"), F.element_at(F.split("k", "/"), -1).alias("tail")).agg(r(F.sum("actual")).alias("actual"))


@query("h04_starts_and_ends_with", sql="""
SELECT CAST(SUM(CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END) AS BIGINT) AS secure, CAST(SUM(CASE WHEN ends_with(url, 'top') THEN 1 ELSE 0 END) AS BIGINT) AS top, CAST(COUNT(*) AS BIGINT) AS cnt FROM pages""")
def _(spark, d):
    u = F.col("url")
    return R.table(spark, d, "pages").agg(
        big(F.sum(u.startswith("https").cast("int"))).alias("secure"), big(F.sum(u.endswith("top").cast("int"))).alias("top"), F.count("*").alias("cnt"))


@query("h05_pad_and_format", sql="""
SELECT '01.' || LPAD(CAST(MONTH(o_orderdate) AS VARCHAR), 2, '0') || '.' || CAST(YEAR(o_orderdate) AS VARCHAR) AS day, CAST(COUNT(*) AS BIGINT) AS cnt FROM orders GROUP BY 1""")
def _(spark, d):
    day = F.format_string("01.%02d.%d", F.month("o_orderdate"), F.year("o_orderdate"))
    return R.table(spark, d, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("cnt"))


@query("h06_full_match", sql="""
SELECT regexp_full_match(p_name, '[A-Za-z0-9_.-]{1,32}') AS plain, CAST(COUNT(*) AS BIGINT) AS cnt, CAST(SUM(CASE WHEN regexp_full_match(p_brand, 'Brand#[0-9]+') THEN 1 ELSE 0 END) AS BIGINT) AS brands FROM part GROUP BY 1""")
def _(spark, d):
    p = R.table(spark, d, "part")
    return p.groupBy(F.col("p_name").rlike("^[A-Za-z0-9_.-]{1,32}$").alias("plain")).agg(
        F.count("*").alias("cnt"), big(F.sum(F.col("p_brand").rlike("^Brand#[0-9]+$").cast("int"))).alias("brands"))


@query("h07_md5", sql="SELECT doc_id, md5(text) AS digest FROM documents")
def _(spark, d):
    return R.table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("h08_month_end_range", sql="""
WITH x AS (SELECT l_suppkey, MIN(CAST(l_shipdate AS DATE)) AS a, MAX(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(last_day(CAST(b + INTERVAL 1 MONTH AS DATE)) AS VARCHAR) AS next_month, CAST((YEAR(b) - YEAR(a)) * 12 + MONTH(b) - MONTH(a) + 1 AS BIGINT) AS months FROM x""")
def _(spark, d):
    from ..operators.series import month_range, month_shift
    x = R.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("a"), F.max(F.col("l_shipdate").cast("date")).alias("b"))
    return x.select("l_suppkey", txt(month_shift("b", 1)).alias("next_month"), big(F.size(month_range("a", "b"))).alias("months"))


@query("h09_date_parse_format", sql="""
SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, CAST(COUNT(*) AS BIGINT) AS cnt FROM orders GROUP BY 1""")
def _(spark, d):
    parsed = F.to_date("order_date", "dd.MM.yyyy")
    return R.po_dates(spark, d).groupBy(F.date_format(parsed, "yyyy-MM").alias("month")).agg(F.count("*").alias("cnt"))


@query("h10_log_exp_sqrt", sql=f"""
SELECT l_returnflag, {rs('SUM(LN(l_extendedprice))', 4)} AS logs, {rs('EXP(AVG(LN(l_extendedprice)))', 4)} AS geometric, {rs('SUM(SQRT(ABS(l_discount - 0.05)))', 4)} AS roots, CAST(SUM(SIGN(l_discount - 0.045)) AS BIGINT) AS signs FROM lineitem GROUP BY 1""")
def _(spark, d):
    x = F.col("l_discount")
    return R.table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        r(F.sum(F.ln("l_extendedprice")), 4).alias("logs"), r(F.exp(F.avg(F.ln("l_extendedprice"))), 4).alias("geometric"),
        r(F.sum(F.sqrt(F.abs(x - 0.05))), 4).alias("roots"), big(F.sum(F.signum(x - 0.045))).alias("signs"))


@query("h11_log1p_expm1", sql=f"""
SELECT l_returnflag, {rs('AVG(LN(1 + l_extendedprice))', 6)} AS mean_log, {rs('EXP(AVG(LN(1 + l_extendedprice))) - 1', 4)} AS back FROM lineitem GROUP BY 1""")
def _(spark, d):
    m = F.avg(F.log1p("l_extendedprice"))
    return R.table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(m, 6).alias("mean_log"), r(F.expm1(m), 4).alias("back"))


@query("h12_clip", sql=f"""
SELECT l_linestatus, {rs('SUM(LEAST(GREATEST(l_quantity, 10), 40))')} AS clipped FROM lineitem GROUP BY 1""")
def _(spark, d):
    q = F.least(F.greatest("l_quantity", F.lit(10.0)), F.lit(40.0))
    return R.table(spark, d, "lineitem").groupBy("l_linestatus").agg(r(F.sum(q)).alias("clipped"))


@query("h13_round_ceil_div_mod", sql="""
SELECT CAST(CEIL(l_quantity / 12.0) AS BIGINT) AS up, CAST(FLOOR(l_quantity / 12.0) AS BIGINT) AS down, CAST(CAST(l_quantity AS BIGINT) % 12 AS BIGINT) AS rest, CAST(COUNT(*) AS BIGINT) AS cnt, CAST(SUM(ROUND(l_extendedprice + 0.001, 0)) AS BIGINT) AS rounded FROM lineitem GROUP BY 1, 2, 3""")
def _(spark, d):
    q = F.col("l_quantity")
    return R.table(spark, d, "lineitem").groupBy(
        F.ceil(q / 12.0).alias("up"), F.floor(q / 12.0).alias("down"), F.pmod(q.cast("bigint"), F.lit(12)).cast("bigint").alias("rest"),
    ).agg(F.count("*").alias("cnt"), big(F.sum(F.round(F.col("l_extendedprice") + 0.001, 0))).alias("rounded"))


@query("h14_conditional_value", sql=f"""
SELECT l_returnflag, {rs("SUM(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_extendedprice END)")} AS open_amount FROM lineitem GROUP BY 1""")
def _(spark, d):
    v = F.when(F.col("l_linestatus") == "F", 0.0).otherwise(F.col("l_extendedprice"))
    return R.table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.sum(v)).alias("open_amount"))


@query("h15_hash_random")
def _(spark, d):
    """Moments of the repeatable uniform and normal numbers over all lines."""
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    u, z = S.hash_uniform(*ids, seed=3), S.hash_normal(*ids, seed=3)
    return R.table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.avg(u).alias("mean_u"), F.stddev(u).alias("std_u"), F.avg(z).alias("mean_z"), F.stddev(z).alias("std_z"))
