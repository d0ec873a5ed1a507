"""Group-by operators. Every one of them pre-aggregates map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month_end_of


def consolidate(df: DataFrame, keys: list[str], attributes: list[str], measure: str, order: list[str] | None = None) -> DataFrame:
    """First of each attribute, nulls skipped, and the sum of the measure.

    Tables have no row order, so "first" goes by ``order`` or, without one, by the value itself.
    """
    if order is None:
        firsts = [F.min(c).alias(c) for c in attributes]
    else:
        firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in attributes]
    return df.groupBy(*keys).agg(*firsts, F.sum(measure).alias(measure))


def sum_by(df: DataFrame, keys: list[str], *measures: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def collapse(df: DataFrame, measure: str) -> DataFrame:
    """One row per distinct combination of all other columns."""
    return sum_by(df, [c for c in df.columns if c != measure], measure)


def past_sums(invoices: DataFrame, keys: list[str], volumes: list[str], year: int, month: int) -> DataFrame:
    """This year's invoices up to ``month``, all volume columns added up."""
    total = sum((F.coalesce(F.col(v), F.lit(0.0)) for v in volumes), F.lit(0.0))
    this_year = invoices.where((F.col("invoice_year") == year) & (F.col("invoice_month") <= month))
    return this_year.groupBy(*keys).agg(F.sum(total).alias("past_sum"))


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def pivot_sum(df: DataFrame, rows: list[str], column: str, labels: list, measure: str, prefix: str = "") -> DataFrame:
    """Sum per label as columns, missing cells 0. Labels are given, so no extra pass finds them."""
    cells = [
        F.coalesce(F.sum(F.when(F.col(column) == label, F.col(measure))), F.lit(0.0)).alias(f"{prefix}{label}")
        for label in labels
    ]
    return df.groupBy(*rows).agg(*cells)


def keep_groups_above(df: DataFrame, keys: list[str], period: str, measure: str, threshold: float) -> DataFrame:
    """Rows of groups whose mean absolute total per period exceeds the threshold."""
    per_period = df.groupBy(*keys, period).agg(F.sum(measure).alias("_s"))
    kept = per_period.groupBy(*keys).agg(F.avg(F.abs("_s")).alias("_m")).where(F.col("_m") > threshold)
    return df.join(kept.select(*keys), keys, "left_semi")


def full_years(df: DataFrame, keys: list[str], year: str, month: str, months: int = 12) -> DataFrame:
    """Rows of (key, year) groups in which every month is present.

    Works on monthly rows; the months present form a bit set, so no distinct shuffle is needed.
    """
    bits = F.bit_or(F.pow(F.lit(2.0), F.col(month) - 1).cast("int"))
    complete = df.groupBy(*keys, year).agg(F.bit_count(bits).alias("_m")).where(F.col("_m") == months)
    return df.join(complete.select(*keys, year), [*keys, year], "left_semi")


def monthly(df: DataFrame, keys: list[str], date: str, measure: str, out: str = "month") -> DataFrame:
    return df.groupBy(*keys, month_end_of(date).alias(out)).agg(F.sum(measure).alias(measure))


def yearly(df: DataFrame, keys: list[str], date: str, measure: str) -> DataFrame:
    return df.groupBy(*keys, F.year(date).alias("year")).agg(F.sum(measure).alias(measure))


def net_by_side(df: DataFrame, out_key: str, in_key: str, measure: str, extra: list[str] = ()) -> DataFrame:
    """Outgoing amounts plus, incoming amounts minus, in one pass over the rows."""
    sides = F.array(
        F.struct(F.lit("out").alias("side"), F.col(out_key).alias("party"), F.col(measure).alias("signed")),
        F.struct(F.lit("in").alias("side"), F.col(in_key).alias("party"), (-F.col(measure)).alias("signed")),
    )
    rows = df.select(*extra, F.explode(sides).alias("_r")).select(*extra, "_r.*")
    return rows.groupBy("side", "party", *extra).agg(F.sum("signed").alias("net"))


def annual_report(df: DataFrame, row: str, source: str, sources: list[str], measure: str) -> DataFrame:
    """Row totals per source as columns plus their sum."""
    wide = pivot_sum(df, [row], source, sources, measure)
    return wide.withColumn("sum", sum((F.col(s) for s in sources), F.lit(0.0)))


def zero_cells(df: DataFrame, measure: str) -> DataFrame:
    """Keep zeros, null everything else."""
    return df.withColumn(measure, F.when(F.col(measure) == 0, F.col(measure)))


def with_share(df: DataFrame, measure: str, out: str = "share", scale: float = 1.0) -> DataFrame:
    """Share of the grand total; the total is a scalar subquery, not a one-task window."""
    grand = df.agg(F.sum(measure)).scalar()
    return df.withColumn(out, F.try_divide(F.col(measure) * F.lit(scale), grand))


def row_percentages(df: DataFrame, row: str, column: str, labels: list, measure: str) -> DataFrame:
    """Each row of the row x column matrix as percentages of its sum."""
    wide = pivot_sum(df, [row], column, labels, measure, prefix="c")
    row_total = sum((F.col(f"c{label}") for label in labels), F.lit(0.0))
    return wide.select(row, *[F.try_divide(F.col(f"c{label}") * 100.0, row_total).alias(f"c{label}") for label in labels])


def split_by_register(df: DataFrame, keys: list[str], measure: str, order: str = "order_id", off: str = "#") -> DataFrame:
    """Totals with and without a registered order, side by side."""
    on = F.col(order) != off
    return df.groupBy(*keys).agg(
        F.sum(F.when(on, F.col(measure)).otherwise(0.0)).alias("on_register"),
        F.sum(F.when(on, 0.0).otherwise(F.col(measure))).alias("off_register"),
        F.max(F.when(on, 1).otherwise(0)).alias("has_on"),
        F.max(F.when(on, 0).otherwise(1)).alias("has_off"),
    )


def children_of(df: DataFrame, parent: str, child: str, measure: str, minimum: float) -> DataFrame:
    """Child totals of at least ``minimum`` under each parent."""
    return df.groupBy(parent, child).agg(F.sum(measure).alias(measure)).where(F.col(measure) >= minimum)


def describe(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Count, moments, quartiles, zero share and variation of calendar-bounded series."""
    v = F.col(measure)
    out = df.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.percentile(v, F.lit(0.25)).alias("q25"),
        F.percentile(v, F.lit(0.5)).alias("q50"),
        F.percentile(v, F.lit(0.75)).alias("q75"),
        F.max(v).alias("max"),
        F.avg(F.when(v == 0, 1.0).otherwise(0.0)).alias("zero_share"),
    )
    return out.withColumn("cv", F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)))


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Density histogram over the whole range; bounds and count are scalar subqueries."""
    x = df.select(value.alias("x")).where(F.col("x").isNotNull())
    low, high, n = x.agg(F.min("x")).scalar(), x.agg(F.max("x")).scalar(), x.agg(F.count("x")).scalar()
    width = (high - low) / F.lit(float(bins))
    at = F.least(F.lit(bins), F.floor(F.try_divide(F.col("x") - low, width)) + 1).alias("bin")
    return x.groupBy(at).agg(F.count("*").alias("count")).select(
        "bin", "count", F.try_divide(F.col("count"), n * width).alias("density"),
    )


def value_counts(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(top)


def variance_explained(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the variance of trend + seasonal + resid that is not residual."""
    whole = F.col("trend") + F.col("seasonal") + F.col("resid")
    out = df.groupBy(*keys).agg(F.var_samp("resid").alias("_r"), F.var_samp(whole).alias("_t"))
    share = F.try_divide("_r", "_t")
    return out.select(*keys, (F.lit(1.0) - share).alias("explained"), share.alias("resid_share"))
