"""The given tables in the roles of budget data, as DataFrames and as the same SQL.

Attributes the tables lack are derived row by row from other columns, so every
role has as many rows as its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fixed_round

CLOSED_TO = "2001-10-31"  # last complete month of the line items
CURR_YEAR, CURR_MONTH = 2001, 10
KEYS = ["huka", "expediture_type", "fc3", "doc_type"]
PAYMENT_YEARS = list(range(1995, 2002))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, digits: int = 2) -> Column:
    return fixed_round(c, digits)


def rs(expr: str, digits: int = 2) -> str:
    """SQL of :func:`r`."""
    return f"FLOOR(({expr}) * {10**digits}.0 + 0.5013) / {10**digits}.0"


def txt(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- payments ----------------------------------------------------------------------

PAYMENT_COLUMNS = """
  CASE WHEN l_tax >= 0.08 THEN '#' ELSE CAST(l_orderkey AS VARCHAR(20)) END AS order_id,
  l_linenumber AS order_line,
  CAST(l_shipdate AS DATE) AS payment_date,
  CAST(YEAR(l_shipdate) + CASE WHEN l_discount > 0.075 THEN 1 WHEN l_discount < 0.025 THEN -1 ELSE 0 END AS INT) AS budget_year,
  CAST(CASE WHEN l_linestatus = 'F' THEN 5 ELSE 1 END AS INT) AS coin,
  5000 + l_linenumber AS huka,
  CASE WHEN l_quantity <= 17 THEN 10 WHEN l_quantity <= 34 THEN 20 ELSE 45 END AS expediture_type,
  CAST(100 + FLOOR(l_discount * 100 + 0.5) AS INT) AS fc3,
  CAST(1000 + l_quantity AS INT) AS fc4,
  CAST(10 + FLOOR(l_quantity / 10) AS INT) AS zroa,
  CASE WHEN l_returnflag = 'A' THEN 'RV' WHEN l_returnflag = 'N' THEN 'DR' ELSE 'ZW' END AS doc_type,
  CASE WHEN l_tax < 0.005 THEN NULL WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_extendedprice ELSE -l_extendedprice END AS mimun,
  l_partkey, l_suppkey
"""
RAW_PAYMENTS = f"raw_payments AS (SELECT {PAYMENT_COLUMNS} FROM lineitem)"
PAYMENTS = RAW_PAYMENTS + """,
payments AS (SELECT order_id, order_line, payment_date, budget_year, coin, huka, expediture_type, fc3, fc4, zroa, doc_type,
  -mimun AS amount, CAST(YEAR(payment_date) AS INT) AS payment_year, CAST(MONTH(payment_date) AS INT) AS payment_month, l_partkey, l_suppkey
  FROM raw_payments WHERE COALESCE(mimun, 0) <> 0 AND budget_year > 1994)"""


def raw_payments(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    shift = F.when(F.col("l_discount") > 0.075, 1).when(F.col("l_discount") < 0.025, -1).otherwise(0)
    credit = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return line.select(
        F.when(F.col("l_tax") >= 0.08, "#").otherwise(txt("l_orderkey")).alias("order_id"),
        F.col("l_linenumber").alias("order_line"),
        F.col("l_shipdate").cast("date").alias("payment_date"),
        (F.year("l_shipdate") + shift).alias("budget_year"),
        F.when(F.col("l_linestatus") == "F", 5).otherwise(1).alias("coin"),
        (F.col("l_linenumber") + 5000).alias("huka"),
        F.when(F.col("l_quantity") <= 17, 10).when(F.col("l_quantity") <= 34, 20).otherwise(45).alias("expediture_type"),
        (F.floor(F.col("l_discount") * 100 + 0.5) + 100).cast("int").alias("fc3"),
        (F.col("l_quantity") + 1000).cast("int").alias("fc4"),
        (F.floor(F.col("l_quantity") / 10) + 10).cast("int").alias("zroa"),
        F.when(F.col("l_returnflag") == "A", "RV").when(F.col("l_returnflag") == "N", "DR").otherwise("ZW").alias("doc_type"),
        F.when(F.col("l_tax") < 0.005, None).when(credit, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice")).alias("mimun"),
        "l_partkey", "l_suppkey",
    )


def payments(spark, d) -> DataFrame:
    from ..plans.spend import clean_payments
    return clean_payments(raw_payments(spark, d), 1994).drop("mimun")


# --- sales orders --------------------------------------------------------------------

RAW_SALES = """raw_sales AS (SELECT CAST(o_orderkey AS VARCHAR(20)) AS order_id,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '#'
       ELSE CAST(YEAR(o_orderdate) AS VARCHAR(4)) || CASE WHEN o_orderstatus = 'F' THEN '5' ELSE '1' END || '00' END AS fund_code,
  o_orderpriority AS sales_office, o_orderstatus AS sales_organistion, o_custkey AS inviting_partner,
  DATEDIFF('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS order_starting_date, o_totalprice AS sales_order_sum FROM orders)"""
SALES = RAW_SALES + """,
sales AS (SELECT *, CAST(DATE '1899-12-30' + CAST(order_starting_date AS INTEGER) AS DATE) AS starting_date,
  CAST(SUBSTR(fund_code, 1, 4) AS INT) AS budget_year, CAST(SUBSTR(fund_code, 5, 1) AS INT) AS coin FROM raw_sales WHERE fund_code <> '#')"""


def raw_sales(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    coin = F.when(F.col("o_orderstatus") == "F", "5").otherwise("1")
    unknown = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return o.select(
        txt("o_orderkey").alias("order_id"),
        F.when(unknown, "#").otherwise(F.concat(F.year("o_orderdate").cast("string"), coin, F.lit("00"))).alias("fund_code"),
        F.col("o_orderpriority").alias("sales_office"), F.col("o_orderstatus").alias("sales_organistion"),
        F.col("o_custkey").alias("inviting_partner"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("bigint").alias("order_starting_date"),
        F.col("o_totalprice").alias("sales_order_sum"),
    )


def sales(spark, d) -> DataFrame:
    from ..plans.spend import clean_orders
    return clean_orders(raw_sales(spark, d), 1994)


# --- purchase orders -------------------------------------------------------------------

PO_ORDERS = """po_orders AS (SELECT CAST(o_orderkey AS VARCHAR(20)) AS doc_id, CAST(1996 + o_orderkey % 6 AS VARCHAR(4)) AS fund_year, '10' AS item,
  o_orderstatus AS po_type, 'H' || SUBSTR(o_orderpriority, 1, 1) AS huka, 'Org' || CAST(o_custkey % 5 AS VARCHAR(1)) AS porcurment_organization,
  CASE WHEN o_totalprice > 250000 THEN 'CapEx' ELSE 'OpEx' END AS expanditure_type, SUBSTR(o_orderpriority, 3) AS fingroup,
  o_totalprice AS po_net_value, CAST(o_orderdate AS DATE) AS order_date, CAST(YEAR(o_orderdate) AS INT) AS order_year, CAST(MONTH(o_orderdate) AS INT) AS order_month FROM orders)"""
PO_INVOICES = """po_invoices AS (SELECT CAST(l_orderkey AS VARCHAR(20)) AS doc_id, CAST(1996 + l_orderkey % 6 AS VARCHAR(4)) AS fund_year, '10' AS item,
  CAST(YEAR(l_shipdate) AS INT) AS invoice_year, CAST(MONTH(l_shipdate) AS INT) AS invoice_month,
  CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END AS RE, CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END AS ZY,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS ZF FROM lineitem)"""
PO_EDITS = """po_edits AS (
  SELECT CAST(o_orderkey AS VARCHAR(20)) AS doc_id, CAST(1996 + o_orderkey % 6 AS VARCHAR(4)) AS fund_year, '10' AS item,
    CAST(YEAR(o_orderdate) * 12 + MONTH(o_orderdate) AS INT) AS edit_abs, o_totalprice AS volume FROM orders
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR(20)), CAST(1996 + l_orderkey % 6 AS VARCHAR(4)), '10',
    CAST(YEAR(l_shipdate) * 12 + MONTH(l_shipdate) AS INT), CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_tax * 100000 END FROM lineitem)"""


def _po_key(order: str) -> list[Column]:
    return [
        txt(order).alias("doc_id"),
        F.concat((F.col(order) % 6 + 1996).cast("string"), F.lit("A")).alias("fund_year"),
        F.lit("10").alias("item"),
    ]


def po_orders(spark, d) -> DataFrame:
    """Raw orders: fund year still with its suffix, value as text with commas."""
    o = table(spark, d, "orders")
    return o.select(
        *_po_key("o_orderkey"), F.col("o_orderstatus").alias("po_type"),
        F.concat(F.lit("H"), F.substring("o_orderpriority", 1, 1)).alias("huka"),
        F.concat(F.lit("Org"), (F.col("o_custkey") % 5).cast("string")).alias("porcurment_organization"),
        F.when(F.col("o_totalprice") > 250000, "CapEx").otherwise("OpEx").alias("expanditure_type"),
        F.substring("o_orderpriority", 3, 100).alias("fingroup"),
        F.format_number("o_totalprice", 2).alias("po_net_value"),
    )


def po_dates(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(*_po_key("o_orderkey"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("order_date"))


def po_invoices(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    def of(flag):
        return F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")).otherwise(0.0)
    return line.select(
        *_po_key("l_orderkey"), F.year("l_shipdate").alias("invoice_year"), F.month("l_shipdate").alias("invoice_month"),
        of("N").alias("RE"), of("A").alias("ZY"), of("R").alias("ZF"),
    )


def po_edits(spark, d) -> DataFrame:
    first = table(spark, d, "orders").select(
        *_po_key("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd").alias("order_date"), F.col("o_totalprice").alias("volume"))
    change = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(-F.col("l_tax") * 100000)
    later = table(spark, d, "lineitem").select(
        *_po_key("l_orderkey"), F.date_format("l_shipdate", "yyyyMMdd").alias("order_date"), change.alias("volume"))
    return first.unionByName(later)


# --- monthly series --------------------------------------------------------------------

BRAND_MONTHS = """bm AS (SELECT p_brand AS k, last_day(CAST(l_shipdate AS DATE)) AS m, SUM(l_extendedprice) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '2001-11-01' GROUP BY 1, 2)"""
BRAND = BRAND_MONTHS + """,
span AS (SELECT k, MIN(m) AS a, MAX(m) AS b FROM bm GROUP BY 1),
grid AS (SELECT k, last_day(CAST(g AS DATE)) AS m FROM span, UNNEST(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) t(g)),
s AS (SELECT grid.k, grid.m, COALESCE(bm.v, 0) AS v, ROW_NUMBER() OVER (PARTITION BY grid.k ORDER BY grid.m) AS i,
  COUNT(*) OVER (PARTITION BY grid.k) AS n FROM grid LEFT JOIN bm ON grid.k = bm.k AND grid.m = bm.m)"""


def brand_rows(spark, d) -> DataFrame:
    """Line amounts with brand and day, up to the last complete month."""
    line = table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("2001-11-01").cast("timestamp_ntz"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("k"))
    return line.join(part, line.l_partkey == part.p_partkey).select("k", F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("v"))


def brand_arrays(spark, d) -> DataFrame:
    from ..operators.series import as_arrays
    return as_arrays(brand_rows(spark, d), ["k"], "date", "v")


def brand_months(spark, d) -> DataFrame:
    from ..operators.series import densify
    return densify(brand_rows(spark, d), ["k"], "date", "v", out_date="m")


# daily events as a short daily series
# accounts ----------------------------------------------------------------------------------

# part types by first word and line status: some swing with their level, as the line items of a month are weighted by its number
ACCOUNTS = f"""am AS (SELECT SPLIT_PART(p_type, ' ', 1) || l_returnflag AS k, last_day(CAST(l_shipdate AS DATE)) AS m,
  SUM(l_extendedprice * CASE WHEN l_returnflag = 'N' THEN POW(1.03, (YEAR(l_shipdate) - 1995) * 12 + MONTH(l_shipdate)) * (1 + MONTH(l_shipdate) % 3) ELSE 1 END) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate <= DATE '{CLOSED_TO}' GROUP BY 1, 2),
ab AS (SELECT k, MIN(m) AS a FROM am GROUP BY 1),
ag AS (SELECT k, last_day(CAST(t AS DATE)) AS m FROM ab, UNNEST(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), TIMESTAMP '{CLOSED_TO}', INTERVAL 1 MONTH)) u(t)),
s0 AS (SELECT ag.k, ag.m, COALESCE(am.v, 0) AS v, ROW_NUMBER() OVER (PARTITION BY ag.k ORDER BY ag.m) AS i, COUNT(*) OVER (PARTITION BY ag.k) AS n FROM ag LEFT JOIN am ON am.k = ag.k AND am.m = ag.m)"""


def accounts(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    month_no = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    swing = F.pow(F.lit(1.03), month_no) * (1 + F.month("l_shipdate") % 3)
    weight = F.when(F.col("l_returnflag") == "N", swing).otherwise(F.lit(1.0))
    return rows.where(F.col("l_shipdate") <= F.lit(CLOSED_TO).cast("date")).select(
        F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), "l_returnflag").alias("k"), F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") * weight).alias("amount"))


DAYS = """days AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, SUM(value) AS v FROM events GROUP BY 1, 2)"""


# budget rows ---------------------------------------------------------------------------

_DOCS = ["ZC", "KR", "KG", "ZW", "ZD", "SA", "KM"]
_FUNDS = [1400, 1401, 1407, 1408, 1409, 1411, 1412, 1413, 1416, 1423, 1425]
_LAWS = [300, 302, 706, 2900, 1316, 9800, 0, 0, 0]
_BUDGET_EXPR = f"""CAST(YEAR(l_shipdate) AS INT) AS financial_year, CAST(MONTH(l_shipdate) AS INT) AS month_no, 'E' || l_linestatus AS economy,
  CASE WHEN l_quantity = 10 THEN 1020 WHEN l_quantity = 20 THEN 1030 WHEN l_quantity > 40 THEN 2010 ELSE 1000 END AS expenditure_type,
  ({_DOCS})[l_linenumber] AS doc_type, ({_FUNDS})[CAST(FLOOR(l_discount * 100 + 0.5) AS INT) + 1] AS fund_code, l_returnflag AS fingroup,
  ({_LAWS})[CAST(FLOOR(l_tax * 100 + 0.5) AS INT) + 1] AS law, l_extendedprice AS volume"""
BUDGET = f"budget AS (SELECT {_BUDGET_EXPR} FROM lineitem)"


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def budget_rows(spark, d) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("financial_year"), F.month("l_shipdate").alias("month_no"),
        F.concat(F.lit("E"), "l_linestatus").alias("economy"),
        F.when(q == 10, 1020).when(q == 20, 1030).when(q > 40, 2010).otherwise(1000).alias("expenditure_type"),
        _pick(_DOCS, F.col("l_linenumber") - 1).alias("doc_type"),
        _pick(_FUNDS, F.floor(F.col("l_discount") * 100 + 0.5).cast("int")).alias("fund_code"),
        F.col("l_returnflag").alias("fingroup"),
        _pick(_LAWS, F.floor(F.col("l_tax") * 100 + 0.5).cast("int")).alias("law"),
        F.col("l_extendedprice").alias("volume"),
    )


def budget_wide(spark, d) -> DataFrame:
    """Budget rows as twelve text month columns: commas in amounts, a dash for none."""
    from ..plans.quarterly import BUDGET_IDS
    cells = []
    for m in range(1, 13):
        total = F.sum(F.when(F.col("month_no") == m, F.col("volume")))
        cells.append(F.coalesce(F.format_number(total, 2), F.lit(" - ")).alias(str(m)))
    return budget_rows(spark, d).groupBy(*BUDGET_IDS).agg(*cells)


# change pairs ---------------------------------------------------------------------------

CHANGES = """changes AS (SELECT CAST(l_orderkey AS VARCHAR(20)) AS doc_id, l_linenumber AS doc_item, 'C' || CAST(p_size % 6 AS VARCHAR(2)) AS mof_class,
  CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 1410 ELSE 1401 END AS fund_code, l_extendedprice AS amount,
  CAST(YEAR(l_shipdate) AS INT) AS year, CAST(MONTH(l_shipdate) AS INT) AS month, 300 AS law
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def change_lines(spark, d) -> DataFrame:
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    fund = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), 1410).otherwise(1401)
    return line.join(part, line.l_partkey == part.p_partkey).select(
        txt("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("doc_item"),
        F.concat(F.lit("C"), (F.col("p_size") % 6).cast("string")).alias("MOF_class"), fund.alias("fund_code"),
        F.format_number("l_extendedprice", 2).alias("110"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), F.lit(300).alias("law"),
    )


# documents --------------------------------------------------------------------------------

_CODES = [50, 51, 60, 61, 78, 79, 99]
DOC_INVOICES = """doc_invoices AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'RE' WHEN l_returnflag = 'A' THEN 'ZY' ELSE 'KG' END AS doc,
  'G' || CAST(l_linenumber AS VARCHAR(1)) AS grp, CAST(YEAR(l_shipdate) AS INT) AS year, CAST(MONTH(l_shipdate) AS INT) AS month, l_extendedprice AS volume FROM lineitem)"""
DOC_ORDERS = """doc_orders AS (SELECT 'O' || o_orderstatus AS doc, 'G' || SUBSTR(o_orderpriority, 1, 1) AS grp, CAST(YEAR(o_orderdate) AS INT) AS year,
  CAST(MONTH(o_orderdate) AS INT) AS month, o_totalprice AS volume, CAST(1996 + o_orderkey % 6 AS INT) AS fund_year FROM orders)"""
DOC_FUNDS = f"""doc_funds AS (SELECT ({_CODES})[l_linenumber] AS doc, 'G' || l_returnflag AS grp, CAST(YEAR(l_shipdate) AS INT) AS year,
  CAST(MONTH(l_shipdate) AS INT) AS month, l_extendedprice AS volume, CAST(1996 + l_orderkey % 6 AS INT) AS fund_year FROM lineitem)"""


def doc_invoices(spark, d) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "RE").when(F.col("l_returnflag") == "A", "ZY").otherwise("KG")
    return table(spark, d, "lineitem").select(
        kind.alias("doc"), F.concat(F.lit("G"), txt("l_linenumber")).alias("group"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), F.col("l_extendedprice").alias("volume"))


def doc_orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.concat(F.lit("O"), "o_orderstatus").alias("doc"), F.concat(F.lit("G"), F.substring("o_orderpriority", 1, 1)).alias("group"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("volume"),
        (F.col("o_orderkey") % 6 + 1996).cast("int").alias("fund_year"))


def doc_funds(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        txt(_pick(_CODES, F.col("l_linenumber") - 1)).alias("doc"), F.concat(F.lit("G"), "l_returnflag").alias("group"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_extendedprice").alias("volume"),
        (F.col("l_orderkey") % 6 + 1996).cast("int").alias("fund_year"))


# catalogue -----------------------------------------------------------------------------------

CATALOG = """catalog AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR(20)) AS name, UPPER(lang) AS source,
  CAST(DATE '2024-01-01' + CAST(n_chars % 300 AS INTEGER) AS VARCHAR(10)) AS creation_date,
  CASE WHEN source = 'src1' THEN 'po-3' WHEN source = 'src2' THEN 'po-1' WHEN source = 'src3' THEN 'ad-hoc-' || lang WHEN source = 'src4' THEN 'ad-hoc-' || lang || ' !'
       WHEN source = 'src5' THEN 'po-3?' ELSE source END AS template,
  DATE '2024-02-01' + CAST(doc_id % 200 AS INTEGER) AS modified, n_chars * 194 + 1 AS size, text FROM documents)"""


def catalog_rows(spark, d) -> DataFrame:
    """Documents as catalogue objects with a composed key."""
    from ..sources.catalog import build_key
    s = F.col("source")
    template = (
        F.when(s == "src1", "po-3").when(s == "src2", "po-1").when(s == "src3", F.concat(F.lit("ad-hoc-"), "lang"))
        .when(s == "src4", F.concat(F.lit("ad-hoc-"), "lang", F.lit(" !"))).when(s == "src5", "po-3?").otherwise(s))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 300).cast("int"))
    docs = table(spark, d, "documents")
    return docs.select(
        build_key(F.concat(F.lit("doc-"), txt("doc_id")), F.upper("lang"), txt(day), template).alias("key"),
        F.date_add(F.lit("2024-02-01").cast("date"), (F.col("doc_id") % 200).cast("int")).alias("modified"),
        (F.col("n_chars") * 194 + 1).alias("size"), "text",
    )


def catalog(spark, d) -> DataFrame:
    from ..sources.catalog import parse_key
    return parse_key(catalog_rows(spark, d)).drop("key", "text")


# forecast and truth files ---------------------------------------------------------------------

TRUTH = """truth AS (SELECT LPAD(CAST(1500 + l_linenumber * 25 AS VARCHAR(6)), 4, '0') || '/' || LPAD(CAST(CAST(l_quantity AS INT) AS VARCHAR(4)), 2, '0') AS k,
  SUM(CASE WHEN YEAR(l_shipdate) = 2000 THEN l_extendedprice ELSE 0 END) AS actual,
  SUM(CASE WHEN YEAR(l_shipdate) = 1999 THEN l_extendedprice ELSE 0 END) AS predicted,
  SUM(CASE WHEN YEAR(l_shipdate) = 1998 THEN l_extendedprice ELSE 0 END) AS alternative,
  CASE WHEN MIN(l_linenumber) <= 2 THEN 'low std' WHEN MIN(l_linenumber) <= 5 THEN 'medium std' ELSE 'high std' END AS cluster
  FROM lineitem GROUP BY 1)"""


def truth(spark, d) -> DataFrame:
    key = F.concat(F.lpad(txt(F.col("l_linenumber") * 25 + 1500), 4, "0"), F.lit("/"), F.lpad(txt(F.col("l_quantity").cast("int")), 2, "0"))
    def year(y):
        return F.sum(F.when(F.year("l_shipdate") == y, F.col("l_extendedprice")).otherwise(0.0))
    first = F.min("l_linenumber")
    return table(spark, d, "lineitem").groupBy(key.alias("k")).agg(
        year(2000).alias("actual"), year(1999).alias("predicted"), year(1998).alias("alternative"),
        F.when(first <= 2, "low std").when(first <= 5, "medium std").otherwise("high std").alias("cluster"))
