"""Purchase-order training table and synthetic future orders."""

from pyspark.sql import functions as F

from .. import KEY
from ..functions import scalars as S
from ..plans import generate, po
from ..session import cut_lineage
from . import query
from . import roles as R
from .joining import HISTORY, history
from .roles import big, r, rs, txt

TRAINING = f"""{HISTORY}, {R.PO_EDITS},
blocks AS (SELECT doc_id, CAST(rel_month // 4 AS INT) AS block, SUM(volume) / LEAST(4, (SELECT MAX(rel_month) FROM history) + 1 - (rel_month // 4) * 4) AS smoothed FROM history GROUP BY 1, 2, rel_month // 4),
aged AS (SELECT doc_id, fund_year, order_year, order_month, fingroup, CAST(a AS INT) AS age FROM po_orders, UNNEST(generate_series(0, 12 * LEAST(10, (2001 * 12 + 10 - order_year * 12 - order_month) // 12) - 1)) t(a)),
changes AS (SELECT doc_id, edit_abs - order_year * 12 - order_month AS rel, SUM(volume) AS v FROM po_edits JOIN po_orders USING (doc_id) WHERE edit_abs >= order_year * 12 + order_month GROUP BY 1, 2),
val AS (SELECT aged.*, SUM(c.v) OVER w AS value, COALESCE(b.smoothed, 0) AS now, COALESCE(SUM(COALESCE(b.smoothed, 0)) OVER (PARTITION BY aged.doc_id ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM aged LEFT JOIN changes c ON c.doc_id = aged.doc_id AND c.rel = aged.age LEFT JOIN blocks b ON b.doc_id = aged.doc_id AND b.block = aged.age // 4
  WINDOW w AS (PARTITION BY aged.doc_id ORDER BY age ROWS UNBOUNDED PRECEDING)),
training AS (SELECT *, before / value AS cumulative_portion, now / (value - before) AS target FROM val WHERE value > 0 AND before / value < 0.98)"""


def prepared(spark, d):
    return po.prepare(R.po_orders(spark, d), R.po_dates(spark, d), R.po_invoices(spark, d), R.po_edits(spark, d))


def training(spark, d, window=4, ready=None, **kw):
    p = ready or prepared(spark, d)
    return po.training_table(p.orders, p.history, p.edits, R.CURR_YEAR, R.CURR_MONTH, window, **kw)


@query("c27_sane_labels", sql=f"""
WITH {TRAINING} SELECT fingroup, CAST(COUNT(*) AS BIGINT) AS cnt, {rs('SUM(target)', 5)} AS target FROM training WHERE target BETWEEN 0 AND 1.05 GROUP BY 1""")
def _(spark, d):
    return po.sane_labels(training(spark, d)).groupBy("fingroup").agg(F.count("*").alias("cnt"), r(F.sum("target"), 5).alias("target"))


_CATEGORIES = po.Features().categorical


@query("c28_feature_typing", sql=f"""
WITH {TRAINING}, rng AS (SELECT MIN(LN(po_net_value)) AS a, MAX(LN(po_net_value)) AS z FROM po_orders),
typed AS (SELECT po_orders.*, CAST(CAST(LEAST(10, GREATEST(1, CEIL((LN(po_net_value) - rng.a) / ((rng.z - rng.a) / 10.0)))) AS INT) AS VARCHAR) AS po_net_value_category
  FROM training JOIN po_orders USING (doc_id), rng),
cells AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, COALESCE({c}, '') AS value FROM typed" for c in _CATEGORIES)}),
counts AS (SELECT feature, value, COUNT(*) AS cnt FROM cells GROUP BY 1, 2)
SELECT feature, CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY cnt DESC, value) - 1 AS BIGINT) AS code, cnt, value FROM counts""")
def _(spark, d):
    """Category codes of all training rows, counted per feature column."""
    features = po.Features()
    rows = po._typed(training(spark, d), features)
    return po.category_codes(rows, features).select("feature", big("code").alias("code"), "cnt", "value")


@query("k06_two_stage_sample")
def _(spark, d):
    """Rows kept per age at a tenth of the copies."""
    return training(spark, d, sample_frac=0.1, seed=5).groupBy(big("age").alias("age")).agg(F.count("*").alias("cnt"))


@query("k07_training_table", sql=f"""
WITH {TRAINING} SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS ages, {rs('SUM(value)', 1)} AS value, {rs('SUM(cumulative_portion)', 5)} AS cumulative_portion, {rs('SUM(target)', 4)} AS target FROM training GROUP BY 1""")
def _(spark, d):
    return training(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("ages"), r(F.sum("po_net_value"), 1).alias("value"),
        r(F.sum("cumulative_portion"), 5).alias("cumulative_portion"), r(F.sum("target"), 4).alias("target"))


@query("k09_hash_split_shares")
def _(spark, d):
    """Rows in the fit and test parts."""
    # the rows are laid out once; both parts are read from what was written
    rows = cut_lineage(training(spark, d).select(*KEY, "age"))
    fit_rows, test_rows = po.split_by_hash(rows, KEY + ["age"])
    return fit_rows.agg(F.count("*").alias("cnt")).select(F.lit("fit").alias("part"), "cnt").unionByName(
        test_rows.agg(F.count("*").alias("cnt")).select(F.lit("test").alias("part"), "cnt"))


@query("k11_inference_rows", sql=f"""
WITH {HISTORY}, aged AS (SELECT *, (2001 - order_year) * 12 + 10 - order_month AS age FROM po_orders WHERE order_year >= 2001 - 7 AND CAST(fund_year AS INT) <= 2001),
p AS (SELECT aged.doc_id, MAX(age) AS age, COALESCE(SUM(CASE WHEN rel_month < age THEN volume END), 0) / MAX(po_net_value) AS cp FROM aged LEFT JOIN history USING (doc_id, fund_year, item) GROUP BY 1)
SELECT doc_id, CAST(age AS BIGINT) AS age, {rs('cp', 7)} AS cumulative_portion FROM p WHERE cp < 0.98 AND age <= 120""")
def _(spark, d):
    orders, past = history(spark, d)
    x = po.inference_rows(orders, past, R.CURR_YEAR, R.CURR_MONTH, 0)
    return x.select("doc_id", big("age").alias("age"), r("cumulative_portion", 7).alias("cumulative_portion"))


# --- generator -------------------------------------------------------------------------

@query("k13_log_normal_moments", sql=f"""
SELECT {rs('AVG(LN(o_totalprice))', 7)} AS mu, {rs('VAR_SAMP(LN(o_totalprice))', 7)} AS sigma_squared FROM orders WHERE o_totalprice > 0""")
def _(spark, d):
    m = generate.log_moments(po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d)))
    return m.select(r("mu", 7).alias("mu"), r("sigma_squared", 7).alias("sigma_squared"))


CLASSED = f"""{R.PO_ORDERS}, b AS (SELECT MIN(LN(po_net_value)) AS a, MAX(LN(po_net_value)) AS z FROM po_orders),
classed AS (SELECT *, CAST(LEAST(100, GREATEST(1, CEIL((LN(po_net_value) - a) / ((z - a) / 100.0)))) AS BIGINT) AS value_class FROM po_orders, b),
long AS ({' UNION ALL '.join(f"SELECT value_class, '{a}' AS attribute, {a} AS value FROM classed" for a in po.ATTRIBUTES)}),
cnt AS (SELECT value_class, attribute, value, COUNT(*) AS n FROM long GROUP BY 1, 2, 3), dom AS (SELECT DISTINCT attribute, value FROM cnt), ks AS (SELECT attribute, COUNT(*) AS k FROM dom GROUP BY 1),
pc AS (SELECT value_class, attribute, SUM(n) AS nc FROM cnt GROUP BY 1, 2),
freq AS (SELECT pc.value_class, pc.attribute, dom.value, (COALESCE(n, 0) + 1.0) / (nc + k) AS p FROM pc JOIN dom ON dom.attribute = pc.attribute JOIN ks ON ks.attribute = pc.attribute
  LEFT JOIN cnt ON cnt.value_class = pc.value_class AND cnt.attribute = pc.attribute AND cnt.value = dom.value)"""


def written_orders(spark, d):
    """Prepared orders as a written table: the class bounds and the classes both read them."""
    return cut_lineage(po.prepare_orders(R.po_orders(spark, d), R.po_dates(spark, d)))


def classed(spark, d):
    return cut_lineage(generate.with_value_class(written_orders(spark, d)))


@query("k14_class_frequencies", sql=f"WITH {CLASSED} SELECT value_class, attribute, value, {rs('p', 8)} AS probability FROM freq")
def _(spark, d):
    x = generate.class_frequencies(classed(spark, d))
    return x.select(big("value_class").alias("value_class"), "attribute", "value", r("probability", 8).alias("probability"))


@query("k14_most_likely_class", sql=f"""
WITH {CLASSED}, pri AS (SELECT value_class, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM classed) AS prior FROM classed GROUP BY 1),
combo AS (SELECT {', '.join(po.ATTRIBUTES)}, COUNT(*) AS rows FROM classed GROUP BY ALL),
sc AS (SELECT {', '.join('combo.' + a for a in po.ATTRIBUTES)}, pri.value_class, LN(prior) + {' + '.join(f'LN(f{i}.p)' for i in range(5))} AS lp FROM combo, pri {' '.join(f"JOIN freq f{i} ON f{i}.value_class = pri.value_class AND f{i}.attribute = '{a}' AND f{i}.value = combo.{a}" for i, a in enumerate(po.ATTRIBUTES))})
, bestc AS (SELECT {', '.join(po.ATTRIBUTES)}, MAX_BY(value_class, lp) AS likely_class FROM sc GROUP BY ALL)
SELECT doc_id, likely_class FROM classed JOIN bestc USING ({', '.join(po.ATTRIBUTES)})""")
def _(spark, d):
    c = classed(spark, d)
    x = generate.class_of_features(generate.class_model(c), c)
    return x.select("doc_id", big("likely_class").alias("likely_class"))


def targets(spark, d):
    """Half of what was ordered per (year, month) of the last two years, as amounts to reach."""
    o = R.table(spark, d, "orders").where(F.year("o_orderdate") >= 2000)
    return o.groupBy(
        txt(F.year("o_orderdate") + 2).alias("year"), txt(F.month("o_orderdate")).alias("month"), F.lit("2003").alias("fund_year"),
    ).agg((F.sum("o_totalprice") / 2).alias("amount"))


def synthetic(spark, d):
    orders = written_orders(spark, d)
    return generate.synthetic_orders(orders.where(F.col("order_year") >= R.CURR_YEAR - 2), targets(spark, d), seed=11)


@query("k15_drawn_attributes")
def _(spark, d):
    return synthetic(spark, d).groupBy("po_type", "fingroup").agg(F.count("*").alias("cnt"))


@query("k16_reach_target_amounts")
def _(spark, d):
    """Generated total per target beside the amount to reach."""
    made = synthetic(spark, d).groupBy("order_date").agg(F.sum("po_net_value").alias("made"), F.count("*").alias("cnt"))
    asked = targets(spark, d).select(F.concat(F.lit("01."), F.lpad("month", 2, "0"), F.lit("."), "year").alias("order_date"), "amount")
    return asked.join(made, "order_date", "left").select("order_date", "amount", "made", "cnt", (F.col("made") >= F.col("amount")).alias("reached"))


@query("k17_synthetic_keys")
def _(spark, d):
    x = synthetic(spark, d)
    return x.groupBy("fund_year", "item").agg(
        F.count("*").alias("orders"), F.countDistinct("doc_id").alias("keys"), F.min("doc_id").alias("first_doc"),
        big(F.sum(F.col("doc_id").rlike("^[0-9]+N$").cast("int"))).alias("well_formed"))
