"""Window operators over period rows.

They expect at most one row per (key, period): run :func:`aggregates.monthly`
or a daily sum first. A partition is then bounded by the calendar however many
source rows one key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def running_sum(df: DataFrame, keys: list[str], order: list[str], measure: str, out: str) -> DataFrame:
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(measure).over(w))


def undo_year_to_date(df: DataFrame, keys: list[str], date: str, cumulative: str, out: str) -> DataFrame:
    """Difference within the year; January keeps its value, a later first month is null."""
    w = Window.partitionBy(*keys, F.year(date)).orderBy(date)
    step = F.col(cumulative) - F.lag(cumulative).over(w)
    return df.withColumn(out, F.when(F.month(date) == 1, F.col(cumulative)).otherwise(step))


def rolling(df: DataFrame, keys, order, measure, function, before: int, after: int, min_rows: int, out: str) -> DataFrame:
    """``function`` over ``before`` rows back to ``after`` rows on, null below ``min_rows``."""
    w = _ordered(keys, order).rowsBetween(-before, after)
    enough = F.count(measure).over(w) >= min_rows
    return df.withColumn(out, F.when(enough, function(measure).over(w)))


def rolling_std(df, keys, order, measure, out="rolling_std", window=12, min_rows=2) -> DataFrame:
    return rolling(df, keys, order, measure, F.stddev_samp, window - 1, 0, min_rows, out)


def centered_mean(df, keys, order, measure, out="trend", window=12) -> DataFrame:
    """Even windows lean back: window 12 covers six rows before to five after."""
    return rolling(df, keys, order, measure, F.avg, window // 2, window - window // 2 - 1, 1, out)


def flag_spikes(df, keys, order, measure, window=12, min_rows=6, threshold=3.0) -> DataFrame:
    """Distance from the rolling mean in rolling standard deviations; the row itself is in the window."""
    w = _ordered(keys, order).rowsBetween(-(window - 1), 0)
    enough = F.count(measure).over(w) >= min_rows
    out = df.withColumns({
        "rolling_mean": F.when(enough, F.avg(measure).over(w)),
        "rolling_std": F.when(enough, F.stddev_samp(measure).over(w)),
    })
    out = out.withColumn("deviation", F.try_divide(F.abs(F.col(measure) - F.col("rolling_mean")), F.col("rolling_std")))
    return out.withColumn("is_spike", F.coalesce(F.col("deviation") > threshold, F.lit(False)))


def interpolate_by_time(df, keys, date, measure, out) -> DataFrame:
    """Linear in days between the known neighbours; leading gaps stay null, trailing ones carry the last value."""
    back = _ordered(keys, [date]).rowsBetween(Window.unboundedPreceding, 0)
    # read backwards: a frame that ends at the partition's end is re-evaluated for every row
    ahead = Window.partitionBy(*keys).orderBy(F.desc(date)).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(measure).isNotNull(), F.struct(F.col(date).alias("d"), F.col(measure).alias("v")))
    filled = df.withColumns({
        "_p": F.last(known, ignorenulls=True).over(back),
        "_n": F.last(known, ignorenulls=True).over(ahead),
    })
    span = F.datediff("_n.d", "_p.d")
    between = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.datediff(F.col(date), "_p.d") / F.nullif(span, F.lit(0))
    value = F.when(F.col(measure).isNotNull(), F.col(measure)).otherwise(F.coalesce(between, F.col("_p.v")))
    return filled.withColumn(out, value).drop("_p", "_n")


def remove_spikes(df, keys, date, measure, **limits) -> DataFrame:
    """Flag spikes, blank them and interpolate; keeps the original as ``raw``."""
    flagged = flag_spikes(df, keys, [date], measure, **limits)
    blanked = flagged.withColumn("_blank", F.when(~F.col("is_spike"), F.col(measure)))
    return interpolate_by_time(blanked, keys, date, "_blank", "clean").drop("_blank").withColumnRenamed(measure, "raw")


def activity(df, keys, date, measure, window=24) -> DataFrame:
    """Share of positive months and rolling moments over ``window`` months."""
    w = _ordered(keys, [date]).rowsBetween(-(window - 1), 0)
    full = F.count(measure).over(w) >= window
    out = df.withColumns({
        "activity_ratio": F.avg(F.when(F.col(measure) > 0, 1.0).otherwise(0.0)).over(w),
        "activity_mean": F.when(full, F.avg(measure).over(w)),
        "activity_std": F.when(full, F.stddev_samp(measure).over(w)),
    })
    return out.withColumn("activity_cv", F.try_divide(F.col("activity_std"), F.abs("activity_mean")))


def lags(df, keys, order, measure, steps=(1, 3, 6, 12)) -> DataFrame:
    w = _ordered(keys, order)
    return df.withColumns({f"{measure}_lag_{k}": F.lag(measure, k).over(w) for k in steps})


def block_mean(df, keys, position, measure, width, out) -> DataFrame:
    """Every row gets the mean of its block of ``width`` positions."""
    w = Window.partitionBy(*keys, F.floor(F.col(position) / width))
    return df.withColumn(out, F.avg(measure).over(w))


def cumulative_before(df, keys, position, measure, out) -> DataFrame:
    """Sum over strictly earlier positions; 0 at the first."""
    w = _ordered(keys, [position]).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(measure).over(w), F.lit(0.0)))


def cumulative_portion(df, keys, position, measure, value) -> DataFrame:
    """Part of the order value invoiced before each position."""
    out = cumulative_before(df, keys, position, measure, "_before")
    return out.withColumn("cumulative_portion", F.try_divide("_before", value)).drop("_before")


def balance_share(df, keys, position, measure, value) -> DataFrame:
    """Share of the balance left before each position that is invoiced at it.

    Null from the position on at which the balance has been exactly zero.
    """
    w = _ordered(keys, [position]).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(measure).over(w), F.lit(0.0))
    out = df.withColumn("_left", F.col(value) - before)
    dry = F.coalesce(F.max(F.when(F.col("_left") == 0, 1).otherwise(0)).over(
        _ordered(keys, [position]).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return out.withColumn("target", F.when(dry == 0, F.try_divide(measure, "_left"))).drop("_left")


def group_total(df, keys, measure, out) -> DataFrame:
    return df.withColumn(out, F.sum(measure).over(Window.partitionBy(*keys)))


def last_and_previous(df, keys, date, measure, months=12) -> DataFrame:
    """Sums of the last and of the preceding ``months`` rows of each series."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))
    ranked = df.withColumn("_rn", rn)
    def part(low, high):
        return F.coalesce(F.sum(F.when(F.col("_rn").between(low, high), F.col(measure))), F.lit(0.0))
    return ranked.groupBy(*keys).agg(
        part(1, months).alias("last_sum"), part(months + 1, 2 * months).alias("previous_sum"),
    )


def trailing(df, keys, date, count) -> DataFrame:
    """The last ``count`` rows of each series."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= count).drop("_rn")


def split_holdout(df, keys, date, count=12) -> DataFrame:
    """Marks the last ``count`` rows of each series as ``test``, the others as ``train``."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))
    return df.withColumn("part", F.when(rn <= count, "test").otherwise("train"))


def average_rank(df, keys, measure, out="rank") -> DataFrame:
    """Rank with ties at their mean; also the size of each tie."""
    first = F.rank().over(_ordered(keys, [measure]))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, measure))
    return df.withColumns({out: first + (ties - 1) / F.lit(2.0), "ties": ties})


def active_start(df, keys, date, measure, window=24, min_ratio=0.5, quantile=0.25) -> DataFrame:
    """First month of each series to forecast from.

    The later of (a) the last month of the most recent stretch of ``window`` + 1
    months (cut at the series end) in which the activity ratio is all zero and
    (b) the first month that is active enough; the series start where neither exists.
    """
    rated = activity(df, keys, date, measure, window)
    # the activity ratio is zero exactly when the window's months are all <= 0
    ahead = _ordered(keys, [date]).rowsBetween(0, window)
    rated = rated.withColumns({
        "_ahead": F.sum("activity_ratio").over(ahead),
        "_ahead_end": F.max(date).over(ahead),
    })
    level = rated.groupBy(*keys).agg(
        F.coalesce(F.percentile(F.when(F.col(measure) > 0, F.col(measure)), F.lit(quantile)), F.lit(0.0)).alias("_q")
    )
    rated = rated.join(level, keys)
    valid = (F.col("activity_ratio") >= min_ratio) & (F.col("activity_mean") >= F.col("_q"))
    starts = rated.groupBy(*keys).agg(
        F.min(date).alias("series_start"),
        F.max_by("_ahead_end", F.when(F.col("_ahead") == 0, F.col(date))).alias("inactive_end"),
        F.min(F.when(valid, F.col(date))).alias("valid_start"),
    )
    return starts.withColumn(
        "active_from",
        F.greatest(F.coalesce("inactive_end", "series_start"), F.coalesce("valid_start", "series_start")),
    )
