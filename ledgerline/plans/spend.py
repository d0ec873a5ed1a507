"""Spend reports over payments and sales orders.

Payments have ``order_id`` (``#`` off register), keys such as ``huka`` and
``zroa``, ``budget_year``, ``payment_year``, ``payment_date`` and ``amount``;
orders have ``order_id``, ``budget_year``, ``starting_date`` and ``sales_order_sum``.
Off-register rows share one order id, so they are kept out of every join by order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_first_date, fund_coin, serial_day
from ..operators import aggregates, ranking
from ..session import cut_lineage

OFF_REGISTER = "#"


def clean_payments(raw: DataFrame, oldest_budget_year: int) -> DataFrame:
    """Dates parsed, empty amounts dropped, sign turned (income arrives negative), old years cut."""
    dated = raw.withColumn("payment_date", day_first_date("paymant_date")) if "paymant_date" in raw.columns else raw
    filled = dated.withColumn("amount", F.coalesce("mimun", F.lit(0.0)) * -1)
    kept = filled.where((F.col("amount") != 0) & (F.col("budget_year") > oldest_budget_year))
    return kept.withColumns({"payment_year": F.year("payment_date"), "payment_month": F.month("payment_date")})


def clean_orders(raw: DataFrame, oldest_budget_year: int) -> DataFrame:
    """Placeholder fund codes dropped; date, budget year and coin derived; rows without a coin dropped."""
    known = raw.where(F.col("fund_code") != OFF_REGISTER)
    out = known.withColumns({
        "starting_date": serial_day("order_starting_date"),
        "budget_year": F.substring("fund_code", 1, 4).cast("int"),
        "coin": fund_coin("fund_code"),
    })
    out = out.withColumn("starting_year", F.year("starting_date"))
    return out.where((F.col("budget_year") > oldest_budget_year) & F.col("coin").isNotNull())


def without_obligations(payments: DataFrame, orders: DataFrame, items: list[int]) -> tuple[DataFrame, DataFrame]:
    """Remove payments of given items and the orders they belong to."""
    hit = payments.where(F.col("po_2").isin(items)).select("order_id").where(F.col("order_id") != OFF_REGISTER)
    return payments.where(F.coalesce(~F.col("po_2").isin(items), F.lit(True))), orders.join(hit, "order_id", "left_anti")


def except_rows(df: DataFrame, conditions: dict) -> DataFrame:
    """Drop rows that meet all conditions; a null in a tested column keeps the row."""
    hit = F.lit(True)
    for c, value in conditions.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(value))
    return df.where(~hit)


def registered(payments: DataFrame) -> DataFrame:
    """Payments that name an order."""
    return payments.where(F.col("order_id") != OFF_REGISTER)


def unregistered(payments: DataFrame) -> DataFrame:
    """Payments that name no order: the off-register mark, or nothing at all."""
    return payments.where(F.coalesce(F.col("order_id") == OFF_REGISTER, F.lit(True)))


def of_years(df: DataFrame, years: int | list[int], column: str = "budget_year") -> DataFrame:
    return df.where(F.col(column).isin(years if isinstance(years, list) else [years]))


def expenditure_by_year(payments: DataFrame, kinds: list) -> DataFrame:
    return aggregates.pivot_sum(payments, ["budget_year"], "expediture_type", kinds, "amount", prefix="type_")


def register_split(payments: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """On- and off-register totals by key; ``inner`` keeps keys with rows on both sides."""
    out = aggregates.split_by_register(payments, keys, "amount")
    if how == "inner":
        out = out.where((F.col("has_on") == 1) & (F.col("has_off") == 1))
    return out.drop("has_on", "has_off").withColumn("total", F.col("on_register") + F.col("off_register"))


def register_split_top(payments: DataFrame, feature: str, top: int, minimum: float, how: str = "inner") -> DataFrame:
    """Yearly split of the features with the largest total among years above the minimum."""
    by_year = register_split(payments, [feature, "budget_year"], how).where(F.col("total") > minimum)
    return ranking.rows_of_top_keys(by_year, [feature], "total", top)


def payments_with_orders(payments: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """Payments per key, order and payment year beside the order value of that budget year (0 if none).

    Payments without an order id have no order value, like those off register; none are lost.
    """
    paid = payments.groupBy(*keys, "order_id", F.col("payment_year").alias("year")).agg(F.sum("amount").alias("amount"))
    ordered = orders.groupBy("order_id", F.col("budget_year").alias("year")).agg(F.sum("sales_order_sum").alias("sales_order_sum"))
    on = registered(paid).join(ordered, ["order_id", "year"], "left")
    off = unregistered(paid).withColumn("sales_order_sum", F.lit(None).cast("double"))
    return on.unionByName(off).withColumn("sales_order_sum", F.coalesce("sales_order_sum", F.lit(0.0)))


def payments_vs_orders(payments: DataFrame, orders: DataFrame, feature: str, top: int, minimum: float) -> DataFrame:
    """Paid and ordered by feature and year for the features that paid most."""
    combined = payments_with_orders(registered(payments), orders, [feature])
    by_year = combined.groupBy(feature, "year").agg(
        F.sum("amount").alias("amount"), F.sum("sales_order_sum").alias("sales_order_sum"))
    return ranking.rows_of_top_keys(by_year.where(F.col("amount") > minimum), [feature], "amount", top)


def payment_year_matrix(payments: DataFrame, years: list[int]) -> DataFrame:
    """Part of each budget year paid in each payment year, in percent."""
    return aggregates.row_percentages(payments, "budget_year", "payment_year", years, "amount")


def early(payments: DataFrame) -> DataFrame:
    return payments.where((F.col("payment_year") < F.col("budget_year")) & (F.col("amount") != 0))


def early_by_year(payments: DataFrame, how: str = "inner") -> DataFrame:
    return register_split(early(payments), ["budget_year"], how)


def early_orders(payments: DataFrame, budget_year: int, payment_year: int) -> DataFrame:
    rows = registered(early(payments)).where(
        (F.col("budget_year") == budget_year) & (F.col("payment_year") == payment_year))
    return rows.select("order_id", "budget_year", "payment_date", "amount").orderBy(F.desc("amount"), "order_id", "payment_date")


def overrun(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders paid beyond their value, by how much."""
    paid = registered(payments).groupBy("order_id").agg(F.sum("amount").alias("amount"))
    ordered = orders.groupBy("order_id").agg(F.sum("sales_order_sum").alias("sales_order_sum"))
    both = paid.join(ordered, "order_id", "left").withColumn("sales_order_sum", F.coalesce("sales_order_sum", F.lit(0.0)))
    return both.withColumn("diff", F.col("amount") - F.col("sales_order_sum")).where(F.col("diff") > 0)


def order_backlog(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Yearly ordered and paid totals without overrun orders; years of either side."""
    over = overrun(payments, orders).select("order_id")
    by_order = registered(payments).groupBy("order_id", F.col("payment_year").alias("year")).agg(F.sum("amount").alias("amount"))
    paid = by_order.join(over, "order_id", "left_anti").groupBy("year").agg(F.sum("amount").alias("amount"))
    by_order = orders.groupBy("order_id", F.col("budget_year").alias("year")).agg(F.sum("sales_order_sum").alias("sales_order_sum"))
    ordered = by_order.join(over, "order_id", "left_anti").groupBy("year").agg(F.sum("sales_order_sum").alias("sales_order_sum"))
    return ordered.join(paid, "year", "full").fillna(0.0, ["amount", "sales_order_sum"])


def paid_by_order_age(payments: DataFrame, orders: DataFrame, today_year: int, min_age: int = 2) -> DataFrame:
    """Percent of the order value paid in the first and second year of its life; orders paid in both."""
    old = orders.where(today_year - F.year("starting_date") >= min_age).groupBy("order_id").agg(
        F.sum("sales_order_sum").alias("sales_order_sum"),
        F.min_by(F.year("starting_date"), F.struct("starting_date")).alias("start_year"),
    )
    paid = registered(payments).groupBy("order_id", "payment_year").agg(F.sum("amount").alias("amount"))
    aged = paid.join(old, "order_id").withColumn("age", F.col("payment_year") - F.col("start_year"))
    share = F.coalesce(F.try_divide(F.col("amount") * 100.0, "sales_order_sum"), F.lit(0.0))
    out = aged.where(F.col("age").isin(1, 2)).groupBy("order_id").agg(
        F.sum(F.when(F.col("age") == 1, share)).alias("percent_first"),
        F.sum(F.when(F.col("age") == 2, share)).alias("percent_second"),
    )
    return out.dropna(subset=["percent_first", "percent_second"])


def top_segments(df: DataFrame, subject: str, measure: str, years, top: int) -> DataFrame:
    """Largest positive totals of any subject and their part of the shown total."""
    grouped = of_years(df, years).where(F.col(subject).isNotNull()).groupBy(subject).agg(F.sum(measure).alias(measure))
    shown = grouped.where(F.col(measure) > 0).orderBy(F.desc(measure), subject).limit(top)
    # at most ``top`` rows are left, so a whole-table sum over them is bounded
    shown_total = shown.agg(F.sum(measure)).scalar()
    return shown.withColumn("percent", F.try_divide(F.col(measure) * 100.0, shown_total))


def active_keys(combined: DataFrame, key: str, measure: str, years: list[int], kinds: list | None = None) -> DataFrame:
    """Keys whose total over the years (and expenditure types) is not zero."""
    rows = of_years(combined, years, "year")
    if kinds is not None:
        rows = rows.where(F.col("expediture_type").isin(kinds))
    return rows.groupBy(key).agg(F.sum(measure).alias("_s")).where(F.abs("_s") > 1e-6).select(key)


def top_active(combined: DataFrame, key: str, measure: str, years: list[int], top: int, rank_years: list[int] | None = None, kinds=None) -> DataFrame:
    """Active keys with the largest totals and their part of all active keys' total."""
    # keys x years x types are few beside the payments; written once, since five steps read them
    compact = cut_lineage(combined.groupBy(key, "year", "expediture_type").agg(F.sum(measure).alias(measure)))
    active = compact.join(active_keys(compact, key, measure, years, kinds), key, "left_semi")
    ranked = of_years(active, rank_years or years, "year")
    leaders = ranking.top_keys(ranked, [key], measure, top)
    grand = active.agg(F.sum(measure)).scalar()
    whole = active.join(leaders.select(key), key, "left_semi").groupBy(key).agg(F.sum(measure).alias("total"))
    return whole.withColumn("percent", F.try_divide(F.col("total") * 100.0, grand))


def biggest_combinations(payments: DataFrame, combined: DataFrame, keys: list[str], years: list[int], top: int) -> DataFrame:
    """Largest key combinations of active keys with their part of the active total."""
    active = active_keys(combined, keys[0], "amount", years)
    rows = payments.join(active, keys[0], "left_semi").where(F.col("payment_year").isin(years))
    return ranking.top_with_share(rows, keys, "amount", top)


def key_years(combined: DataFrame, key: str) -> DataFrame:
    """Per key and year: on- and off-register payments and the order value."""
    on = F.col("order_id") != OFF_REGISTER
    return combined.groupBy(key, "year").agg(
        F.sum(F.when(on, F.col("amount")).otherwise(0.0)).alias("on_register"),
        F.sum(F.when(on, 0.0).otherwise(F.col("amount"))).alias("off_register"),
        F.sum("sales_order_sum").alias("sales_order_sum"),
    )


def key_detail(payments: DataFrame, key: str, value, by: str, labels: list) -> DataFrame:
    """Yearly totals of one key by a second attribute."""
    rows = payments.where(F.col(key) == value)
    return aggregates.pivot_sum(rows, ["payment_year"], by, labels, "amount", prefix=f"{by}_")


def key_expenditure_share(payments: DataFrame, key: str) -> DataFrame:
    """Expenditure types of each key in percent of the key."""
    by_kind = payments.groupBy(key, "expediture_type").agg(F.sum("amount").alias("amount"))
    totals = by_kind.groupBy(key).agg(F.sum("amount").alias("_t"))
    return by_kind.join(totals, key).select(
        key, "expediture_type", "amount", F.try_divide(F.col("amount") * 100.0, "_t").alias("percent"))


def parent_children(payments: DataFrame, parent: str, child: str, minimum: float) -> DataFrame:
    """Children of at least the minimum under the parents of at least the minimum."""
    pairs = payments.groupBy(parent, child).agg(F.sum("amount").alias("amount"))
    parents = pairs.groupBy(parent).agg(F.sum("amount").alias("parent_amount")).where(F.col("parent_amount") >= minimum)
    return pairs.where(F.col("amount") >= minimum).join(parents, parent)
