"""Seasonality and residual tests over calendar-bounded series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..operators.windows import average_rank


def _rank_table(df: DataFrame, keys: list[str], group: Column, measure: str) -> DataFrame:
    ranked = average_rank(df.withColumn("_g", group), keys, measure, "_rank")
    per_group = ranked.groupBy(*keys, "_g").agg(
        F.sum("_rank").alias("rank_sum"), F.count(F.lit(1)).alias("rows"),
        # every row of a tie of size t carries t*t - 1, so a tie adds t^3 - t in all
        F.sum(F.col("ties") * F.col("ties") - 1).alias("tie_part"),
    )
    return per_group


def kruskal_by_month(df: DataFrame, keys: list[str], date: str, measure: str) -> DataFrame:
    """Kruskal-Wallis H over calendar months with tie correction, degrees of freedom and p value."""
    groups = _rank_table(df, keys, F.month(date), measure)
    n = F.sum("rows").cast("double")
    out = groups.groupBy(*keys).agg(
        (F.lit(12.0) / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("rows")) - 3.0 * (n + 1)).alias("_h"),
        (F.lit(1.0) - F.try_divide(F.sum("tie_part").cast("double"), n * n * n - n)).alias("_c"),
        (F.count(F.lit(1)) - 1).cast("int").alias("df"),
    )
    out = out.withColumn("h", F.try_divide("_h", "_c")).drop("_h", "_c")
    return out.withColumn("p", chi_square_tail(F.col("h"), F.col("df")))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(h: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution by its finite sum for whole degrees of freedom."""
    def one(x, k):
        if x is None or np.isnan(x) or k < 1:
            return None
        half = max(x, 0.0) / 2.0
        if k % 2:
            tail = math.erfc(math.sqrt(half))
            term, start = math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 1.5
        else:
            tail, term, start = 0.0, math.exp(-half), 1.0
        for i in range(k // 2):
            tail += term
            term *= half / (start + i)
        return tail
    return pd.Series([one(x, int(k)) for x, k in zip(h, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(x) / math.sqrt(2.0)) if x == x else None for x in z], dtype="float64")


def dunn_by_month(df: DataFrame, keys: list[str], date: str, measure: str) -> DataFrame:
    """Dunn's pairwise month comparison with Bonferroni adjustment (at most 66 pairs per series)."""
    groups = _rank_table(df, keys, F.month(date), measure)
    packed = groups.groupBy(*keys).agg(
        F.sum("rows").cast("double").alias("n"), F.sum("tie_part").cast("double").alias("t"),
        F.array_sort(F.collect_list(F.struct(
            F.col("_g").alias("month"), (F.col("rank_sum") / F.col("rows")).alias("mean"), F.col("rows").alias("rows"),
        ))).alias("months"),
    )
    left = packed.select("*", F.posexplode("months").alias("_i", "a"))
    pairs = left.withColumn("b", F.explode(F.slice("months", F.col("_i") + 2, F.size("months"))))
    spread = (F.col("n") * (F.col("n") + 1) / 12.0 - F.col("t") / (12.0 * (F.col("n") - 1)))
    z = (F.col("a.mean") - F.col("b.mean")) / F.sqrt(spread * (F.lit(1.0) / F.col("a.rows") + F.lit(1.0) / F.col("b.rows")))
    count = F.size("months") * (F.size("months") - 1) / 2
    return pairs.select(
        *keys, F.col("a.month").alias("month_a"), F.col("b.month").alias("month_b"), z.alias("z"),
        F.least(F.lit(1.0), normal_two_sided(z) * count).alias("p_adjusted"),
    )


def yearly_std_from_months(df: DataFrame, keys: list[str], date: str, measure: str) -> DataFrame:
    """Square root of the summed variances per calendar month."""
    months = df.groupBy(*keys, F.month(date).alias("_m")).agg(F.var_samp(measure).alias("_v"))
    return months.groupBy(*keys).agg(F.sqrt(F.sum("_v")).alias("yearly_std"))


KPSS_LIMIT = 0.463  # five-percent value of the level test


def kpss(values: Column) -> Column:
    """Statistic of the test that a series moves around a fixed level; null for a constant or empty one.

    Sum of squared partial sums of the deviations over their long-run variance, whose autocovariances up to
    ``3 * sqrt(n) / 13`` lags weigh less with the lag.
    """
    def lagged(e: Column, n: Column, lags: Column, j: Column) -> Column:
        weight = F.lit(1.0) - j / (lags + 1.0)
        return weight * A.dot(F.slice(e, F.lit(1), n - j), F.slice(e, j + 1, n - j))

    def statistic(e: Column) -> Column:
        n = F.size(e)
        lags = F.floor(F.sqrt(n) * 3 / 13).cast("int")
        start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))
        partial = F.aggregate(
            e, start, lambda s, x: F.struct((s["run"] + x).alias("run"), (s["squares"] + (s["run"] + x) * (s["run"] + x)).alias("squares")),
            lambda s: s["squares"])
        spread = A.total(F.transform(A.positions(1, lags), lambda j: lagged(e, n, lags, j)))
        variance = F.try_divide(A.dot(e, e) + 2.0 * spread, n)
        return F.when(variance > 0, F.try_divide(partial, n * n * variance))

    return A.let(A.let(values, lambda v: A.let(A.mean(v), lambda m: F.transform(v, lambda x: x - m))), statistic)


def difference(values: Column) -> Column:
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(2), n), F.slice(values, F.lit(1), n), lambda later, earlier: later - earlier)


def differences_needed(values: Column, most: int = 2) -> Column:
    """How often a series has to be differenced, up to ``most`` times, until the level test no longer rejects it."""
    needed, at = F.lit(most), [values]
    for _ in range(most - 1):
        at.append(difference(at[-1]))
    for d in range(most - 1, -1, -1):
        needed = F.when(F.coalesce(kpss(at[d]), F.lit(0.0)) <= KPSS_LIMIT, F.lit(d)).otherwise(needed)
    return needed


def autocorrelation(df: DataFrame, keys: list[str], date: str, measure: str, max_lag: int = 48) -> DataFrame:
    """Autocorrelation of a series per lag 1..min(max_lag, rows - 1); one sort serves all lags."""
    w = Window.partitionBy(*keys)
    centred = df.where(F.col(measure).isNotNull()).withColumn("_c", F.col(measure) - F.avg(measure).over(w))
    packed = centred.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(date, "_c"))), lambda s: s["_c"]).alias("c"),
    )
    n = F.size("c")
    lagged = packed.where(n > 1).select(
        *keys, "c", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_lag), n - 1))).alias("lag"),
    )
    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    shifted = F.zip_with(
        F.slice("c", F.lit(1), n - F.col("lag")), F.slice("c", F.col("lag") + 1, n - F.col("lag")), lambda a, b: a * b,
    )
    square = F.transform("c", lambda x: x * x)
    return lagged.select(*keys, "lag", F.try_divide(total(shifted), total(square)).alias("acf"))
