"""Seasonal analysis of every series in one plan: kind of decomposition, components, trend, season, bounds.

Whether a series is split as it is or in logs is decided per series and carried through: its components, its trend and
its bounds live on that scale, and the way back by ``expm1`` comes last. Bounds of series in logs are therefore not
symmetric around the forecast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..forecast import decompose as D
from ..forecast import models as M
from ..functions import arrays as A
from ..operators import series, windows
from ..operators.series import month_shift
from ..session import cut_lineage

MULTIPLICATIVE = "multiplicative"


def decomposition_kinds(months: DataFrame, keys: list[str], date: str, measure: str) -> DataFrame:
    """keys and ``decomposition`` of every series; one with negative months, or too short to tell, is additive."""
    both = windows.rolling_std(windows.centered_mean(months, keys, [date], measure), keys, [date], measure)
    negative = months.groupBy(*keys).agg((F.min(measure) < 0).alias("has_negative"))
    told = negative.join(D.variance_diagnostics(both, keys), keys, "left")
    return D.decomposition_type(told).select(*keys, "decomposition")


def _back(kind: str, value: Column) -> Column:
    return F.when(F.col(kind) == MULTIPLICATIVE, F.expm1(value)).otherwise(value)


def components(months: DataFrame, keys: list[str], date: str, measure: str) -> DataFrame:
    """Trend, seasonal and residual of each month on the scale of its series' ``decomposition``."""
    kinds = decomposition_kinds(months, keys, date, measure)
    scaled = months.join(kinds, keys).withColumn(
        "_scaled", F.when(F.col("decomposition") == MULTIPLICATIVE, F.log1p(measure)).otherwise(F.col(measure)))
    return D.classical(scaled, keys, date, "_scaled").drop("_scaled")


def packed_components(parts: DataFrame, keys: list[str], date: str, target_year: int) -> DataFrame:
    """One row per series: known trend in order, all seasonal values, spreads of the residual by month and by year."""
    yearly = parts.where(F.col("resid").isNotNull()).groupBy(*keys, F.year(date).alias("_y")).agg(F.sum("resid").alias("_r"))
    spread = yearly.groupBy(*keys).agg(F.stddev_samp("_r").alias("yearly_std"))
    known = lambda c: F.transform(F.filter("_o", lambda o: o[c].isNotNull()), lambda o: o[c])
    recent = F.year(date).isin(target_year - 2, target_year - 1)
    out = parts.groupBy(*keys).agg(
        F.first("decomposition").alias("decomposition"), F.min(date).alias("first_month"), F.max(date).alias("last_month"),
        F.stddev_samp("resid").alias("monthly_std"), F.sum(F.when(recent, F.col("trend"))).alias("recent_trend"),
        F.array_sort(F.collect_list(F.struct(date, "trend", "seasonal"))).alias("_o"),
    )
    return out.select("*", known("trend").alias("trend"), known("seasonal").alias("seasonal")).drop("_o").join(spread, keys, "left")


def monthly_forecast(packed: DataFrame, keys: list[str], target_year: int, steps: int, z: float = D.DEFAULT_Z) -> DataFrame:
    """keys, decomposition, month, value, lower, upper of the target year.

    The trend goes on as a parabola from its last known month, half a year before the last month of the series. It is
    zero after two silent years, and damped where it would fall below zero though the known trend never did. Months of
    the year that are known keep their own components.
    """
    half = D.PERIOD // 2
    ahead = steps + half
    path = D.quiet_or_damped(M.quadratic_trend(F.col("trend"), ahead), F.col("trend"), F.coalesce("recent_trend", F.lit(0.0)), ahead)
    with_path = A.computed_once(packed, _path=path)
    season = F.concat("seasonal", D.tile_season(F.col("seasonal"), steps))
    # the first half year has no trend
    trend = F.concat(F.array_repeat(F.lit(None).cast("double"), half), "trend", "_path")
    whole = F.zip_with(trend, season, lambda t, s: t + s)
    rows = with_path.select(*keys, "decomposition", "first_month", "monthly_std", "yearly_std", F.posexplode_outer(whole).alias("_p", "_v"))
    dated = rows.withColumn("month", month_shift("first_month", F.col("_p"))).where(F.year("month") == target_year)
    bound = lambda sign, std: _back("decomposition", F.col("_v") + F.lit(sign * z) * F.col(std))
    return dated.select(
        *keys, "decomposition", "month", _back("decomposition", F.col("_v")).alias("value"),
        bound(-1, "monthly_std").alias("lower"), bound(1, "monthly_std").alias("upper"),
        bound(-1, "yearly_std").alias("_low_year"), bound(1, "yearly_std").alias("_high_year"), "yearly_std")


def yearly_forecast(monthly: DataFrame, keys: list[str], z: float = D.DEFAULT_Z) -> DataFrame:
    """keys, decomposition, value, lower, upper of the year: in logs the sums of the months moved by the yearly spread,
    else the year's sum moved by it once."""
    total = monthly.groupBy(*keys, "decomposition").agg(
        F.sum("value").alias("value"), F.sum("_low_year").alias("_low"), F.sum("_high_year").alias("_high"), F.max("yearly_std").alias("_std"))
    logs = F.col("decomposition") == MULTIPLICATIVE
    return total.select(
        *keys, "decomposition", "value",
        F.when(logs, F.col("_low")).otherwise(F.col("value") - F.lit(z) * F.col("_std")).alias("lower"),
        F.when(logs, F.col("_high")).otherwise(F.col("value") + F.lit(z) * F.col("_std")).alias("upper"))


def run(rows: DataFrame, keys: list[str], date: str, measure: str, known_to: str, target_year: int, z: float = D.DEFAULT_Z) -> tuple[DataFrame, DataFrame]:
    """(monthly, yearly) forecast with bounds of every series.

    A series too sparse to split, under two years or with fewer than twelve positive months, is forecast by the mean of
    its last yearly sums, with decomposition ``none`` and no bounds.
    """
    arrays = cut_lineage(series.sparse(series.as_arrays(rows, keys, date, measure, known_to)))
    thin = F.col("is_sparse") | (F.size("values") < 2 * D.PERIOD)
    months = series.from_arrays(arrays.where(~thin).drop("is_sparse"), keys, "month", "value")
    known_year, known_month = int(known_to[:4]), int(known_to[5:7])
    steps = (target_year - known_year) * 12 + 12 - known_month
    packed = cut_lineage(packed_components(components(months, keys, "month", "value"), keys, "month", target_year))
    dense = monthly_forecast(packed, keys, target_year, steps, z)
    few = D.sparse_mean(series.from_arrays(arrays.where(thin).drop("is_sparse"), keys, "month", "value"), keys, "month", "value", target_year)
    none = F.lit(None).cast("double")
    few = few.select(*keys, F.lit("none").alias("decomposition"), F.last_day(F.make_date(F.lit(target_year), "month_no", F.lit(1))).alias("month"),
                     "value", none.alias("lower"), none.alias("upper"), none.alias("_low_year"), none.alias("_high_year"), none.alias("yearly_std"))
    monthly = dense.unionByName(few)
    return monthly.drop("_low_year", "_high_year", "yearly_std"), yearly_forecast(monthly, keys, z)
