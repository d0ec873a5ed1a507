"""Forecast accuracy over slices of the key space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import joins


def r2() -> Column:
    squares = F.sum(F.pow(F.col("actual") - F.col("predicted"), 2))
    spread = F.var_pop("actual") * F.count("actual")
    return F.when(F.count("actual") >= 2, F.lit(1.0) - F.try_divide(squares, spread))


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)))


def log_rmse() -> Column:
    """Pairs without two finite logarithms do not count."""
    both = (F.col("actual") > 0) & (F.col("predicted") > 0)
    gap = F.when(both, F.ln("actual") - F.ln("predicted"))
    return F.sqrt(F.avg(gap * gap))


def win_share() -> Column:
    """Part of the keys on which the forecast beats the alternative."""
    closer = F.abs(F.col("actual") - F.col("predicted")) < F.abs(F.col("actual") - F.col("alternative"))
    return F.avg(F.when(F.col("alternative").isNotNull(), closer.cast("double")))


# Named aggregate expressions; callers may add their own.
METRICS = {"r2_score": r2, "root_mean_squared_error": rmse, "log_rmse": log_rmse, "comparison": win_share}


def paired(forecast: DataFrame, truth: DataFrame, dimension: DataFrame, key: str, alternative: DataFrame | None = None) -> DataFrame:
    """Forecast and truth over exactly the keys of the dimension, missing values 0."""
    out = dimension.join(forecast.withColumnRenamed("value", "predicted"), key, "left")
    out = out.join(truth.withColumnRenamed("value", "actual"), key, "left")
    out = out.fillna(0.0, ["predicted", "actual"])
    if alternative is None:
        return out.withColumn("alternative", F.lit(None).cast("double"))
    return out.join(alternative.withColumnRenamed("value", "alternative"), key, "left").fillna(0.0, ["alternative"])


def slices(data: DataFrame, key: str, focus: str, prefixes: list[str], cluster: str, top: int = 30) -> DataFrame:
    """One row per (slice, key): all, one key, the largest, given prefixes, shared suffixes, cluster."""
    data = cut_lineage(data)  # one row per key, read for the leaders, the suffixes and the slices
    suffix = F.element_at(F.split(key, "/"), -1)
    head = F.split_part(key, F.lit("/"), F.lit(1))
    leaders = data.orderBy(F.desc("actual"), key).limit(top).select(key, F.lit(True).alias("_top"))
    shared = data.groupBy(suffix.alias("_suffix")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    marked = data.withColumn("_suffix", suffix).join(leaders, key, "left").join(shared, "_suffix", "left")
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.col(key).startswith(p)
    labels = F.array_compact(F.array(
        F.lit("all"),
        F.when(F.col(key) == focus, F.lit(focus)),
        F.when(F.col("_top"), F.lit(f"TOP {top}")),
        F.when(starts, head),
        F.when(F.col("_n").isNotNull(), F.col("_suffix")),
        F.col(cluster),
    ))
    return marked.withColumn("slice", F.explode(labels)).drop("_suffix", "_top", "_n")


def scores(sliced: DataFrame, by: str = "slice", metrics: dict | None = None) -> DataFrame:
    """Slice x metric matrix in one aggregation."""
    chosen = metrics or METRICS
    return sliced.groupBy(by).agg(*[m().alias(name) for name, m in chosen.items()])


def yearly_errors(df: DataFrame, order: list[str] = ()) -> DataFrame:
    """Absolute and relative error per series, sorted by ``order`` if given; the forecast of a series without actuals counts as 0."""
    out = df.withColumn("forecast", F.when(F.col("actual") == 0, F.lit(0.0)).otherwise(F.col("forecast")))
    out = out.withColumn("abs_err", F.abs(F.col("forecast") - F.col("actual")))
    out = out.withColumn("rel_err", F.round(F.try_divide("abs_err", "actual"), 2))
    return out.orderBy(*order) if order else out


def against_actual_years(forecast: DataFrame, payments: DataFrame, keys: list[str], year: str, measure: str, years: list[int]) -> DataFrame:
    """Forecast beside the actual totals of given years; keys silent in all of them drop out. A null is a key like any other."""
    actual = payments.groupBy(*keys).agg(*[
        F.sum(F.when(F.col(year) == y, F.col(measure)).otherwise(0.0)).alias(f"actual_{y}") for y in years
    ])
    names = [f"actual_{y}" for y in years]
    out = joins.full_by_keys(forecast, actual, keys)
    out = out.fillna(0.0, [c for c in out.columns if c not in keys])
    alive = F.lit(False)
    for c in names:
        alive = alive | (F.col(c) != 0)
    return out.where(alive)


def history_with_forecast(payments: DataFrame, forecast: DataFrame, feature: str, year: str, measure: str, target_year: int, top: int = 10) -> DataFrame:
    """Yearly history of the features with the largest forecast, with the forecast year appended."""
    ahead = forecast.groupBy(feature).agg(F.sum("value").alias(measure))
    leaders = ahead.orderBy(F.desc(measure), feature).limit(top)
    past = payments.groupBy(feature, F.col(year).cast("int").alias("year")).agg(F.sum(measure).alias(measure))
    past = past.join(leaders.select(feature), feature, "left_semi")
    return past.unionByName(leaders.select(feature, F.lit(target_year).alias("year"), measure))
