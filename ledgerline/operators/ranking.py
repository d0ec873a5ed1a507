"""Top-N operators. A global top-N is ``orderBy.limit``: each task keeps N rows, nothing is sorted whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def top_keys(df: DataFrame, keys: list[str], measure: str, n: int) -> DataFrame:
    """The N keys with the largest totals, ties by key."""
    totals = df.groupBy(*keys).agg(F.sum(measure).alias(measure))
    return totals.orderBy(F.desc(measure), *keys).limit(n)


def rows_of_top_keys(df: DataFrame, keys: list[str], measure: str, n: int) -> DataFrame:
    """All rows of the top-N keys. The N-row side is bounded by the parameter."""
    return df.join(top_keys(df, keys, measure, n).select(*keys), keys, "left_semi")


def top_with_share(df: DataFrame, keys: list[str], measure: str, n: int) -> DataFrame:
    """Top-N combinations with their percentage of the whole total."""
    grand = df.agg(F.sum(measure)).scalar()
    return top_keys(df, keys, measure, n).withColumn("percent", F.try_divide(F.col(measure) * 100.0, grand))


def largest(df: DataFrame, measure: str, n: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc(measure), *ties).limit(n)


def top_and_other(df: DataFrame, key: str, measure: str, n: int, other: str = "Other") -> DataFrame:
    """Totals by absolute size: the N largest keys and one row for all others."""
    sizes = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.abs(F.sum(measure)).alias("size"))
    leaders = sizes.orderBy(F.desc("size"), key).limit(n)
    rest = sizes.join(leaders.select(key), key, "left_anti").agg(F.sum("size").alias("size"))
    return leaders.unionByName(rest.where(F.col("size").isNotNull()).select(F.lit(other).alias(key), "size"))


def ranks_in_ranges(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Adds ``out``, the place (from 0) of each row within ``keys`` in ``order``, for keys of any size.

    Rows are dealt into ordered ranges and written, the rows of each range are counted, and places are given inside
    the ranges, so no task sees all rows of a key. ``order`` must tell all rows of a key apart.
    """
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    placed = dealt.withColumn("_place", F.row_number().over(inside) - 1).join(starts, [*keys, "_range"])
    return placed.withColumn(out, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")
