"""Joins and set operations between orders, dated edits, invoices, payments and dimensions.

Sides that grow are not hinted to broadcast: the size check stays with Spark
(``autoBroadcastJoinThreshold`` and adaptive execution). Fact sides are summed to
their join grain first, so that a hot key meets the join as few rows; where rows
must stay rows, adaptive execution splits the skewed partitions of a plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest in ``order``. An aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def attach_dates(orders: DataFrame, dates: DataFrame, keys: list[str], fmt: str = "dd.MM.yyyy") -> DataFrame:
    """Inner join of orders with their first date row; adds order year and month."""
    one = first_per_key(dates.select(*keys, "order_date"), keys, ["order_date"])
    joined = orders.join(one, keys, "inner")
    if dict(joined.dtypes)["order_date"] == "string":
        joined = joined.withColumn("order_date", F.to_date("order_date", fmt))
    return joined.withColumns({
        "order_date": F.col("order_date").cast("date"),
        "order_year": F.year("order_date"),
        "order_month": F.month("order_date"),
    })


def orders_with_invoices(invoices: DataFrame, orders: DataFrame, keys: list[str], volumes: list[str]) -> DataFrame:
    """Every order with its invoices; an order without any gets one zero row in its own month.

    Invoices of unknown orders drop out, so the full join is a left join from the orders.
    """
    joined = orders.select(*keys, "order_year", "order_month").join(invoices, keys, "left")
    return joined.withColumns({
        "invoice_year": F.coalesce("invoice_year", "order_year"),
        "invoice_month": F.coalesce("invoice_month", "order_month"),
        **{v: F.coalesce(F.col(v), F.lit(0.0)) for v in volumes},
    })


def left_fill(left: DataFrame, right: DataFrame, on: list[str], fill: list[str], value=0.0) -> DataFrame:
    """Left join whose missing measures become ``value``."""
    joined = left.join(right, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in fill})


def outer_fill(left: DataFrame, right: DataFrame, on: list[str], fill: list[str], value=0.0) -> DataFrame:
    joined = left.join(right, on, "full")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in fill})


def join_with_suffixes(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str], how="inner") -> DataFrame:
    """Equi-join that renames the measures both sides share."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    for c in shared:
        left = left.withColumnRenamed(c, c + suffixes[0])
        right = right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, on, how)


def edits_within_age(copies: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Range join: edits from the order month up to ``age`` months later.

    ``copies`` has the keys, ``order_abs`` and ``age``; ``edits`` the keys,
    ``edit_abs`` and ``volume``. The equality on the keys keeps it a hash or
    sort-merge join, and edits are summed per month before it.
    """
    monthly = edits.groupBy(*keys, "edit_abs").agg(F.sum("volume").alias("volume"))
    low = F.col("order_abs")
    return copies.join(monthly, keys, "inner").where(F.col("edit_abs").between(low, low + F.col("age")))


def edit_sums_as_of(copies: DataFrame, edits: DataFrame, keys: list[str], out: str = "volume", ages: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of the edits from the order month up to ``age`` months later; rows without an edit by then drop out.

    The edits of a key become two arrays, their months in order and the sums up to each. Every row of ``copies`` meets
    its key once and looks up two places, so there are never more rows than copies. With ``ages``, an array, ``copies``
    are the orders themselves: they become one row per ``age`` behind the join, which so sorts no copies.
    """
    monthly = edits.groupBy(*keys, "edit_abs").agg(F.sum("volume").alias("v"))
    packed = monthly.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("edit_abs", "v"))).alias("_e"))
    sums = F.aggregate(
        "_e", F.array().cast("array<double>"), lambda done, e: F.concat(done, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), done), -1), F.lit(0.0)) + e["v"])))
    arrays = packed.select(*keys, F.transform("_e", lambda e: e["edit_abs"]).alias("_months"), sums.alias("_sums"))
    met = copies.join(arrays, keys)
    if ages is not None:
        met = met.withColumn("age", F.explode(ages))
    until = lambda limit: F.size(F.filter("_months", lambda m: m <= limit))
    placed = met.withColumns({"_from": until(F.col("order_abs") - 1), "_to": until(F.col("order_abs") + F.col("age"))})
    at = lambda place: F.coalesce(F.get("_sums", place - 1), F.lit(0.0))
    summed = placed.where(F.col("_to") > F.col("_from")).withColumn(out, at(F.col("_to")) - at(F.col("_from")))
    return summed.drop("_months", "_sums", "_from", "_to")


def reindex_to(dimension: DataFrame, facts: DataFrame, on: list[str], fill: list[str]) -> DataFrame:
    """Exactly the keys of the dimension; facts outside it drop out, gaps are 0."""
    return left_fill(dimension.select(*on), facts.select(*on, *fill), on, fill)


def common_keys(first: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of all sides on their shared keys."""
    for other in others:
        first = first.join(other, on, "inner")
    return first


def not_in(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Anti join; rows whose key is null stay."""
    return left.join(right.select(*on).where(~_any_null(on)), on, "left_anti")


def present_in(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_semi")


def _any_null(cols: list[str]) -> Column:
    found = F.lit(False)
    for c in cols:
        found = found | F.col(c).isNull()
    return found


def key_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of the left side that the right side lacks."""
    return left.select(*on).subtract(right.select(*on))


def pair_lines(lines: DataFrame, doc: str, item: str, klass: str, carried: list[str]) -> DataFrame:
    """Lines 1 and 2 of a document as one (out, in) row; the other values come from line 1."""
    def of(n: int, c: str) -> Column:
        return F.max(F.when(F.col(item) == n, F.col(c)))

    return lines.where(F.col(item).isin(1, 2)).groupBy(doc).agg(
        of(1, klass).alias("class_out"),
        of(2, klass).alias("class_in"),
        *[of(1, c).alias(c) for c in carried],
    )


def copies_over_ages(orders: DataFrame, curr_year: int, curr_month: int, max_years: int = 10) -> DataFrame:
    """One copy set per whole year ``k`` of order age: ages 0..12k-1 for orders at least k years old."""
    months_old = F.lit(curr_year * 12 + curr_month) - (F.col("order_year") * 12 + F.col("order_month"))
    whole_years = F.least(F.lit(max_years), F.floor(months_old / 12).cast("int"))
    old_enough = orders.withColumn("_years", whole_years).where(F.col("_years") >= 1)
    by_year = old_enough.withColumn("years_old", F.explode(F.sequence(F.lit(1), "_years")))
    return by_year.withColumn("age", F.explode(F.sequence(F.lit(0), F.col("years_old") * 12 - 1))).drop("_years")


def with_whole_years(orders: DataFrame, curr_year: int, curr_month: int, max_years: int = 10) -> DataFrame:
    """Adds ``_years``, an order's whole years by now up to ``max_years``; orders under a year drop out."""
    months_old = F.lit(curr_year * 12 + curr_month) - (F.col("order_year") * 12 + F.col("order_month"))
    whole_years = F.least(F.lit(max_years), F.floor(months_old / 12).cast("int"))
    return orders.withColumn("_years", whole_years).where(F.col("_years") >= 1)


def ages_with_weight(orders: DataFrame, curr_year: int, curr_month: int, max_years: int = 10) -> DataFrame:
    """The distinct ages of :func:`copies_over_ages` with the number of copies as ``copies``.

    Up to ten times fewer rows than the copies themselves.
    """
    old_enough = with_whole_years(orders, curr_year, curr_month, max_years)
    aged = old_enough.withColumn("age", F.explode(F.sequence(F.lit(0), F.col("_years") * 12 - 1)))
    return aged.withColumn("copies", F.col("_years") - F.floor(F.col("age") / 12).cast("int")).drop("_years")


def full_by_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join in which null keys meet; the other columns of both sides follow the keys."""
    a = left.select(F.struct(*keys).alias("_key"), *[c for c in left.columns if c not in keys])
    b = right.select(F.struct(*keys).alias("_of"), *[c for c in right.columns if c not in keys])
    met = a.join(b, a["_key"].eqNullSafe(b["_of"]), "full").withColumn("_key", F.coalesce("_key", "_of")).drop("_of")
    return met.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *[c for c in met.columns if c != "_key"])


def align_on(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Dates present on both sides."""
    return left.join(right, on, "inner")


def with_order_attribute(payments: DataFrame, orders: DataFrame, attribute: str, order_line: list[str]) -> DataFrame:
    """Payments with the first non-null attribute of their order; payments without one drop out."""
    known = orders.where(F.col(attribute).isNotNull())
    one = known.groupBy("order_id").agg(F.min_by(attribute, F.struct(*order_line)).alias(attribute))
    return payments.join(one, "order_id", "inner")
