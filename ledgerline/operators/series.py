"""Dense monthly series, in long form and as one array per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import computed_once
from ..functions.scalars import col, month_end_of


def month_range(first, last) -> Column:
    """Array of month-end dates from first to last, both included."""
    starts = F.sequence(F.trunc(col(first), "month"), F.trunc(col(last), "month"), F.expr("interval 1 month"))
    return F.transform(starts, lambda d: F.last_day(d))


def month_shift(date, months) -> Column:
    return F.last_day(F.add_months(col(date), months))


def as_arrays(df: DataFrame, keys: list[str], date: str, measure: str, known_to: str | None = None) -> DataFrame:
    """One row per key: ``first_month``, ``last_month`` and ``values`` without gaps (0 where no rows).

    Source rows are summed to (key, month) before anything is collected, so an
    array holds at most one number per calendar month. ``known_to`` extends
    every series with zeros to a month the data is known to reach.
    """
    months = df.groupBy(*keys, month_end_of(date).alias("_m")).agg(F.sum(measure).alias("_v"))
    last = F.max("_m") if known_to is None else F.greatest(F.max("_m"), F.lit(known_to).cast("date"))
    packed = months.groupBy(*keys).agg(
        F.min("_m").alias("first_month"),
        last.alias("last_month"),
        F.map_from_entries(F.collect_list(F.struct("_m", "_v"))).alias("_by_month"),
    )
    value = F.transform(
        month_range("first_month", "last_month"),
        lambda m: F.coalesce(F.try_element_at(F.col("_by_month"), m), F.lit(0.0)),
    )
    return computed_once(packed, values=value).select(*keys, "first_month", "last_month", "values")


def spread_series(df: DataFrame, keys: list[str]) -> DataFrame:
    """One-row-per-series frames are few bytes but much work: keep them on all shuffle partitions.

    A given partition number is not merged by adaptive execution, which sizes by
    bytes. It is one more than the shuffle setting, because a repartition equal
    to the partitioning already there is dropped as redundant (and then merged).
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    return df.repartition(count, *keys)


def from_arrays(arrays: DataFrame, keys: list[str], date: str, measure: str) -> DataFrame:
    """Back to one row per (key, month)."""
    zipped = F.arrays_zip(month_range("first_month", "last_month").alias("d"), F.col("values").alias("v"))
    return arrays.select(*keys, F.explode_outer(zipped).alias("_r")).select(
        *keys, F.col("_r.d").alias(date), F.col("_r.v").alias(measure),
    )


def densify(df, keys, date, measure, known_to=None, out_date="month") -> DataFrame:
    """Every month between each key's own first and last month, missing ones 0."""
    return from_arrays(as_arrays(df, keys, date, measure, known_to), keys, out_date, measure)


def fill_common_span(df: DataFrame, keys: list[str], date: str, measure: str, out_date="month") -> DataFrame:
    """Every key over the months of the whole table; the span is a scalar subquery."""
    months = df.groupBy(*keys, month_end_of(date).alias("_m")).agg(F.sum(measure).alias("_v"))
    first, last = months.agg(F.min("_m")).scalar(), months.agg(F.max("_m")).scalar()
    packed = months.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_m", "_v"))).alias("_by"))
    bounded = packed.withColumns({"_first": first, "_last": last})
    spanned = bounded.withColumn("_month", F.explode_outer(month_range("_first", "_last")))
    return spanned.select(
        *keys, F.col("_month").alias(out_date),
        F.coalesce(F.try_element_at("_by", "_month"), F.lit(0.0)).alias(measure),
    )


def horizon(arrays: DataFrame, keys: list[str], target_year: int) -> DataFrame:
    """Months after each series' end up to December of the target year."""
    end = F.make_date(F.lit(target_year), F.lit(12), F.lit(31))
    open_ended = arrays.where(F.col("last_month") < end)
    following = month_range(month_shift("last_month", 1), end)
    return open_ended.select(*keys, F.posexplode(following).alias("_p", "month")).select(
        *keys, (F.col("_p") + 1).alias("step"), "month",
    )


def eligibility(arrays: DataFrame, target_year: int, holdout: int = 12) -> DataFrame:
    """Adds ``is_bad``: too short, silent at the end, or stopped before the year ahead of the target."""
    from ..functions import arrays as A

    values = F.col("values")
    short = F.size(values) < 2 * holdout
    silent = A.total(A.tail(values, 2 * holdout)) == 0
    stopped = F.year("last_month") < target_year - 1
    return arrays.withColumn("is_bad", short | silent | stopped)


def sparse(arrays: DataFrame, minimum: int = 12) -> DataFrame:
    """Adds ``is_sparse``: fewer than ``minimum`` positive months."""
    positive = F.size(F.filter("values", lambda v: v > 0))
    return arrays.withColumn("is_sparse", positive < minimum)


def stitch(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Observed and forecast months under one schema with their origin."""
    return actual.withColumn("origin", F.lit("actual")).unionByName(forecast.withColumn("origin", F.lit("forecast")))


def min_max_scale(df: DataFrame, keys: list[str], measure: str, out: str = "scaled") -> DataFrame:
    """Scale each series to [0, 1] and keep its bounds for the way back; a constant series is 0."""
    bounds = df.groupBy(*keys).agg(F.min(measure).alias("low"), F.max(measure).alias("high"))
    scaled = F.coalesce(F.try_divide(F.col(measure) - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return df.join(bounds, keys).withColumn(out, scaled)


def unscale(c, low="low", high="high") -> Column:
    return col(c) * (col(high) - col(low)) + col(low)


def year_pairs(df: DataFrame, keys: list[str], date: str, measure: str) -> DataFrame:
    """24-month sequences (previous year, this year) with input and target shifted by one month."""
    ordered = F.array_sort(F.collect_list(F.struct(F.month(date).alias("m"), F.col(measure).alias("v"))))
    years = df.groupBy(*keys, F.year(date).alias("year")).agg(ordered.alias("_o"))
    years = years.where(F.size("_o") == 12).select(*keys, "year", F.col("_o.v").alias("values"))
    earlier = years.select(*keys, (F.col("year") + 1).alias("year"), F.col("values").alias("_before"))
    pairs = years.join(earlier, [*keys, "year"])
    both = F.concat("_before", "values")
    return pairs.select(
        *keys, "year", both.alias("sequence"),
        F.slice(both, 1, 23).alias("input"), F.slice(both, 2, 23).alias("target"),
    )
