"""Revenue run: every key combination from daily payments to a yearly forecast, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..forecast import decompose as D
from ..functions import arrays as A
from ..operators import evaluate, series, windows
from ..operators.series import month_shift
from ..functions.scalars import months_between_parts
from ..session import cut_lineage


def clean_daily(payments: DataFrame, keys: list[str]) -> DataFrame:
    """Daily sums per key with spikes replaced."""
    daily = payments.groupBy(*keys, "payment_date").agg(F.sum("amount").alias("amount"))
    return windows.remove_spikes(daily, keys, "payment_date", "amount")


def full_arrays(clean: DataFrame, keys: list[str], measure: str = "clean") -> DataFrame:
    """Dense monthly history of each key; written once, since everything after reads it several times."""
    return cut_lineage(series.as_arrays(clean, keys, "payment_date", measure))


def active_arrays(full: DataFrame, keys: list[str], known_to: str) -> DataFrame:
    """Histories from their active start to the known end, zeros after the last payment."""
    dense = series.from_arrays(full, keys, "month", "value")
    start = windows.active_start(dense, keys, "month", "value").select(*keys, "active_from")
    end = F.greatest(F.col("last_month"), F.lit(known_to).cast("date"))
    skipped = _months_apart("first_month", "active_from")
    added = F.array_repeat(F.lit(0.0), _months_apart("last_month", end))
    values = F.concat(F.slice("values", skipped + 1, F.size("values") - skipped), added)
    out = A.computed_once(full.join(start, keys), _values=values, _end=end)
    return out.select(
        *keys, F.col("active_from").alias("first_month"), F.col("_end").alias("last_month"), F.col("_values").alias("values"))


def _months_apart(first, last):
    return months_between_parts(F.year(last), F.month(last), F.year(first), F.month(first))


def decomposed(arrays: DataFrame, keys: list[str], minimum: int = 12) -> DataFrame:
    """Components of the series with enough positive months and two full periods."""
    enough = series.sparse(arrays, minimum).where(~F.col("is_sparse") & (F.size("values") >= 2 * D.PERIOD))
    return D.stl(series.spread_series(enough.drop("is_sparse"), keys))


def base_forecast(parts: DataFrame, keys: list[str], steps: int, target_year: int) -> DataFrame:
    """Trend (searched order, kept from falling below zero) plus last season, per month of the target year.

    Months of the target year already observed keep their components.
    """
    found = D.trend_search(parts, "trend", steps)
    zero = F.array_repeat(F.lit(0.0), F.lit(steps))
    saved = D.non_negative_path(F.col("trend"), steps, last_n=10, start=2.0, limit=10.0)
    path = A.let(
        F.when(A.total(F.col("trend_forecast")) < 0, saved).otherwise(F.col("trend_forecast")),
        lambda p: F.when(A.total(p) < 0, zero).otherwise(p))
    ahead = D.combine(path, D.tile_season(F.col("seasonal"), steps))
    whole = F.concat(F.zip_with("trend", "seasonal", lambda t, s: t + s), ahead)
    # outer explode: the inner one adds a filter that would run the python functions a second time
    rows = found.select(*keys, "first_month", F.posexplode_outer(whole).alias("_p", "value"))
    dated = rows.select(*keys, month_shift("first_month", F.col("_p")).alias("month"), "value")
    return dated.where(F.year("month") == target_year)


def yearly_forecast(base: DataFrame, resid: DataFrame | None, keys: list[str]) -> DataFrame:
    """Yearly totals with and without the residual part; a negative total with it becomes 0."""
    joined = base.withColumn("_with", F.col("value"))
    if resid is not None:
        extra = resid.withColumnRenamed("value", "_extra")
        joined = base.join(extra, [*keys, "month"], "left").withColumn(
            "_with", F.col("value") + F.coalesce("_extra", F.lit(0.0)))
    out = joined.groupBy(*keys).agg(F.sum("_with").alias("_w"), F.sum("value").alias("total_forecasted_value_no_resid"))
    return out.select(
        *keys, F.greatest("_w", F.lit(0.0)).alias("total_forecasted_value"), "total_forecasted_value_no_resid")


def sparse_forecast(full: DataFrame, sparse_keys: DataFrame, keys: list[str], target_year: int) -> DataFrame:
    """Mean of the last yearly sums for the series too sparse to model."""
    months = series.from_arrays(full.join(sparse_keys.select(*keys), keys, "left_semi"), keys, "month", "value")
    monthly = D.sparse_mean(months, keys, "month", "value", target_year)
    return monthly.groupBy(*keys).agg(F.sum("value").alias("total_forecasted_value")).withColumn(
        "total_forecasted_value_no_resid", F.lit(0.0))


def with_actuals(forecast: DataFrame, payments: DataFrame, keys: list[str], years: list[int]) -> DataFrame:
    """Beside the actual years; a negative forecast falls back to the last actual year."""
    out = evaluate.against_actual_years(forecast, payments, keys, "payment_year", "amount", years)
    last = F.col(f"actual_{years[-1]}")
    return out.withColumn("total_forecasted_value", D.replace_negative(F.col("total_forecasted_value"), last))


def run(payments: DataFrame, keys: list[str], known_to: str, target_year: int, actual_years: list[int], resid: DataFrame | None = None) -> DataFrame:
    """The whole batch. ``known_to`` is the last complete month, ``resid`` an optional (keys, month, value) part."""
    full = full_arrays(clean_daily(payments, keys), keys)
    arrays = active_arrays(full, keys, known_to)
    parts = decomposed(arrays, keys)
    known_year, known_month = int(known_to[:4]), int(known_to[5:7])
    steps = (target_year + 1 - known_year) * 12 - known_month
    dense = yearly_forecast(base_forecast(parts, keys, steps, target_year), resid, keys)
    too_sparse = series.sparse(arrays).where(F.col("is_sparse") | (F.size("values") < 2 * D.PERIOD))
    all_keys = dense.unionByName(sparse_forecast(full, too_sparse, keys, target_year))
    return with_actuals(all_keys, payments, keys, actual_years)
