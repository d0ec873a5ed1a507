"""Sources and sinks. Every query writes whole tables below the shared folder and reads them back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import catalog as C
from ..sources import tables as S
from . import query
from . import roles as R
from .roles import big, r, rs, txt

LINE_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_extendedprice", T.DoubleType()), T.StructField("l_returnflag", T.StringType()),
])
_BY_FLAG = f"SELECT l_returnflag, CAST(COUNT(*) AS BIGINT) AS cnt, {rs('SUM(l_extendedprice)')} AS amount FROM lineitem GROUP BY 1"


def _lines(spark, d):
    return R.table(spark, d, "lineitem").select(*LINE_SCHEMA.fieldNames())


def _by_flag(df):
    return df.groupBy("l_returnflag").agg(F.count("*").alias("cnt"), r(F.sum("l_extendedprice")).alias("amount"))


@query("a01_csv_with_declared_types", sql=_BY_FLAG)
def _(spark, d):
    path = S.write_table(_lines(spark, d), scratch_path(spark, "lines"), "csv")
    return _by_flag(S.read_csv(spark, path, LINE_SCHEMA))


@query("a02_column_pruned_scan", sql=f"SELECT l_suppkey, {rs('SUM(l_quantity)')} AS quantity FROM lineitem GROUP BY 1")
def _(spark, d):
    return R.table(spark, d, "lineitem").select("l_suppkey", "l_quantity").groupBy("l_suppkey").agg(r(F.sum("l_quantity")).alias("quantity"))


@query("a03_csv_encoding_fallback", sql="""
SELECT doc_id, md5(REPLACE(REPLACE(REPLACE(text, '"', ' '), chr(92), ' '), chr(10), ' ')) AS digest FROM documents""")
def _(spark, d):
    flat = F.regexp_replace("text", r'["\\\n]', " ")
    docs = R.table(spark, d, "documents").select("lang", "doc_id", F.concat(F.lit("<"), flat, F.lit(">")).alias("text"))
    path = scratch_path(spark, "mixed")  # files of one language in the single-byte code beside files in UTF-8
    docs.where("lang = 'fr'").drop("lang").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    docs.where("lang <> 'fr' OR lang IS NULL").drop("lang").write.mode("append").option("header", True).csv(path)
    back = S.read_csv_any_encoding(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    return back.select("doc_id", F.md5(F.regexp_extract("text", "(?s)^<(.*)>$", 1)).alias("digest"))


@query("a04_normal_headers", sql="SELECT r_regionkey AS region_key, r_name AS region_name FROM region")
def _(spark, d):
    odd = R.table(spark, d, "region").toDF(" Region-Key ", "REGION name")
    return S.with_normal_headers(odd)


_SALES_SCHEMA = T.StructType([T.StructField("order_id", T.StringType()), T.StructField("order_line", T.IntegerType()), T.StructField("amount", T.DoubleType()), T.StructField("flag", T.StringType())])


@query("a05_rename_by_position", sql=f"SELECT flag, {rs('SUM(amount)')} AS amount, CAST(SUM(order_line) AS BIGINT) AS lines FROM (SELECT l_returnflag AS flag, l_extendedprice AS amount, l_linenumber AS order_line FROM lineitem) q GROUP BY 1")
def _(spark, d):
    text = _lines(spark, d).select(*[txt(c).alias(c) for c in LINE_SCHEMA.fieldNames()])
    known = S.as_known_table(text, "sales", {"sales": _SALES_SCHEMA})
    return known.groupBy("flag").agg(r(F.sum("amount")).alias("amount"), big(F.sum("order_line")).alias("lines"))


@query("a06_strict_cast", sql="SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders")
def _(spark, d):
    text = R.table(spark, d, "orders").select(txt("o_orderkey").alias("o_orderkey"), txt("o_custkey").alias("o_custkey"))
    return S.strict_cast(text, T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType())]))


@query("a07_lenient_cast", sql="""
SELECT CAST(COUNT(x) AS BIGINT) AS readable, CAST(COUNT(*) - COUNT(x) AS BIGINT) AS unreadable FROM (SELECT TRY_CAST(SPLIT_PART(p_name, ' ', 2) AS DOUBLE) AS x FROM part UNION ALL SELECT TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) FROM part) q""")
def _(spark, d):
    p = R.table(spark, d, "part")
    words = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("t")).unionByName(p.select(txt("p_size").alias("t")))
    return words.select(S.lenient_number("t").alias("x")).agg(F.count("x").alias("readable"), (F.count("*") - F.count("x")).alias("unreadable"))


@query("a08_read_by_catalogue_name", sql=_BY_FLAG)
def _(spark, d):
    path = S.write_table(_lines(spark, d), scratch_path(spark, "stored"), "csv")
    catalog = spark.createDataFrame([("lines", "po-3", path), ("other", "po-1", path)], "name string, template string, path string")
    return _by_flag(S.strict_cast(C.read(spark, catalog, "lines", "po-3"), LINE_SCHEMA))


@query("a09_cached_read", sql=_BY_FLAG)
def _(spark, d):
    path = scratch_path(spark, "cache")
    S.cached_read(spark, path, lambda: _lines(spark, d))
    return _by_flag(S.cached_read(spark, path, lambda: _lines(spark, d).limit(0)))


@query("a10_table_sinks", sql=_BY_FLAG)
def _(spark, d):
    rows = _by_flag(_lines(spark, d))
    path = S.write_table(rows, scratch_path(spark, "out"), "csv")
    back = S.read_csv(spark, path, rows.schema)
    return back.select("l_returnflag", "cnt", "amount")


@query("a11_split_sink", sql=_BY_FLAG)
def _(spark, d):
    path = S.write_split(_lines(spark, d), scratch_path(spark, "split"), ["l_returnflag"])
    return _by_flag(spark.read.parquet(path))


@query("a12_types_with_current_january", sql=f"""
WITH {R.BUDGET}, x AS (SELECT doc_type, last_day(make_date(financial_year, month_no, 1)) AS m, SUM(volume) AS v FROM budget WHERE NOT (doc_type IN ('KM', 'SA') AND financial_year = 2001 AND month_no = 1) GROUP BY 1, 2)
SELECT doc_type, {rs('SUM(v)')} AS volume FROM x WHERE doc_type IN (SELECT doc_type FROM x WHERE m = DATE '2001-01-31') GROUP BY 1""")
def _(spark, d):
    b = R.budget_rows(spark, d)
    quiet = F.col("doc_type").isin("KM", "SA") & (F.col("financial_year") == 2001) & (F.col("month_no") == 1)
    rows = b.where(~quiet).withColumn("month", F.last_day(F.make_date("financial_year", "month_no", F.lit(1))))
    kept = S.types_with_current_january(rows, "doc_type", "month", 2001)
    return kept.groupBy("doc_type").agg(r(F.sum("volume")).alias("volume"))


@query("a13_many_files_with_drift", sql=f"""
SELECT kind, CAST(COUNT(*) AS BIGINT) AS cnt, {rs('SUM(amount)')} AS amount, CAST(COUNT(supplier) AS BIGINT) AS suppliers FROM (SELECT 'line' AS kind, l_extendedprice AS amount, l_suppkey AS supplier FROM lineitem UNION ALL SELECT 'order', o_totalprice, NULL FROM orders) q GROUP BY 1""")
def _(spark, d):
    a = R.table(spark, d, "lineitem").select(F.lit("line").alias("kind"), F.col("l_extendedprice").alias("amount"), F.col("l_suppkey").alias("supplier"))
    b = R.table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount"))
    paths = [S.write_table(x, scratch_path(spark, "part")) for x in (a, b)]
    return S.read_many(spark, paths).groupBy("kind").agg(F.count("*").alias("cnt"), r(F.sum("amount")).alias("amount"), F.count("supplier").alias("suppliers"))


@query("a15_run_table", sql=f"""
WITH runs AS (SELECT l_returnflag AS flag, CAST(COUNT(*) AS BIGINT) AS rows, {rs('SUM(l_extendedprice)')} AS amount FROM lineitem GROUP BY 1)
SELECT 'flag-' || flag AS run_id, 'param' AS kind, 'flag' AS name, flag AS value, CAST(NULL AS DOUBLE) AS number FROM runs
UNION ALL SELECT 'flag-' || flag, 'metric', 'rows', CAST(rows AS VARCHAR), CAST(rows AS DOUBLE) FROM runs
UNION ALL SELECT 'flag-' || flag, 'metric', 'amount', NULL, amount FROM runs""")
def _(spark, d):
    """One run per return flag, its parameter and scores appended and read back; amounts are compared as numbers."""
    path = scratch_path(spark, "runs")
    for run in _by_flag(_lines(spark, d)).collect():  # one row per flag
        S.append_run(spark, path, f"flag-{run.l_returnflag}", {"flag": run.l_returnflag}, {"rows": run.cnt, "amount": run.amount})
    back = spark.read.parquet(path)
    amount = F.col("name") == "amount"
    return back.select("run_id", "kind", "name", F.when(~amount, F.col("value")).alias("value"), F.when(F.col("kind") == "metric", F.col("value").cast("double")).alias("number"))


@query("a16_target_lines", sql=f"""
SELECT CAST(YEAR(o_orderdate) AS VARCHAR) AS year, CAST(MONTH(o_orderdate) AS VARCHAR) AS month, CAST(YEAR(o_orderdate) + 1 AS VARCHAR) AS fund_year, {rs('SUM(o_totalprice)')} AS amount FROM orders GROUP BY 1, 2, 3""")
def _(spark, d):
    o = R.table(spark, d, "orders")
    line = F.concat_ws(" | ", txt(F.year("o_orderdate")), txt(F.month("o_orderdate")), txt(F.year("o_orderdate") + 1), F.concat(F.format_string("%.2f", "o_totalprice"), F.lit(" # planned")))
    noise = o.select(F.concat(F.lit("# "), "o_orderpriority").alias("value")).unionByName(o.select(F.lit("mode: train").alias("value")))
    path = scratch_path(spark, "targets")
    o.select(line.alias("value")).unionByName(noise).write.text(path)
    parsed = S.parse_targets(spark.read.text(path))
    return parsed.select("year", "month", "fund_year", r("amount").alias("amount"))
