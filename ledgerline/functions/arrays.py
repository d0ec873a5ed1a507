"""Small helpers over ``array<double>`` columns that hold one calendar-bounded series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def tail(values: Column, count: int) -> Column:
    """Last ``count`` items (all items of a shorter array)."""
    n = F.size(values)
    return F.when(n <= count, values).otherwise(F.slice(values, n - count + 1, F.lit(count)))


def positions(low, high) -> Column:
    """Integer positions low..high, empty when high < low."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    empty = F.array().cast("array<int>")
    return F.when(high >= low, F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).otherwise(empty)


def steps(count: int, build: Callable[[Column], Column]) -> Column:
    """Array built from step numbers 1..count."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), build)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an intermediate value once inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are too costly to be evaluated twice.

    A filter on a plain computed column is pushed below it, which repeats the
    whole expression in the filter, once per reference. Filters on the output of
    an explode stay above it; exploding a one-item array keeps the rows as they are.
    """
    item = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*df.columns, F.explode_outer(F.array(item)).alias("_once")).select(
        *kept, *[F.col(f"_once.{name}").alias(name) for name in columns])
