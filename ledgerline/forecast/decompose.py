"""Seasonal decomposition, trend forecasts and their combination with bounds."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from .diagnostics import differences_needed
from .models import holt_fit

PERIOD = 12
R2_LIMIT = 0.5
ELASTICITY_LIMIT = 0.1
DEFAULT_Z = 0.95  # factor of the published bounds; the two-sided 95 % value is 1.96
DAMPING = [0.8, 0.9, 0.98]


# --- additive or multiplicative ----------------------------------------------

def variance_diagnostics(trend_and_std: DataFrame, keys: list[str]) -> DataFrame:
    """Line of rolling std on trend: slope, r2 and elasticity (slope times mean ratio)."""
    both = trend_and_std.where(F.col("trend").isNotNull() & F.col("rolling_std").isNotNull())
    out = both.groupBy(*keys).agg(
        F.regr_slope("rolling_std", "trend").alias("slope"),
        F.regr_r2("rolling_std", "trend").alias("r2"),
        F.try_divide(F.avg("trend"), F.avg("rolling_std")).alias("_ratio"),
    )
    return out.withColumn("elasticity", F.col("slope") * F.col("_ratio")).drop("_ratio")


def decomposition_type(diagnosed: DataFrame, has_negative: str = "has_negative") -> DataFrame:
    scales = (F.col("r2") > R2_LIMIT) & (F.col("elasticity") > ELASTICITY_LIMIT)
    kind = F.when(F.col(has_negative), "additive").when(scales, "multiplicative").otherwise("additive")
    return diagnosed.withColumn("decomposition", kind)


# --- decomposition -------------------------------------------------------------

def classical(df: DataFrame, keys: list[str], date: str, measure: str, kind: str = "additive", period: int = PERIOD) -> DataFrame:
    """Trend by a centred 2x12 mean, seasonal by mean detrended calendar month (sum zero), rest residual.

    Native windows only. Trend and residual are null for the half year at both ends.
    ``multiplicative`` works on log1p values, as does the caller's expm1 afterwards.
    """
    value = F.log1p(measure) if kind == "multiplicative" else F.col(measure)
    w = Window.partitionBy(*keys).orderBy(date)
    half = period // 2
    full = F.count(F.lit(1)).over(w.rowsBetween(-half, half)) == period + 1
    wide = F.sum("_v").over(w.rowsBetween(-half, half)) - (F.lag("_v", half).over(w) + F.lead("_v", half).over(w)) / 2.0
    out = df.withColumn("_v", value).withColumn("trend", F.when(full, wide / float(period)))
    by_month = Window.partitionBy(*keys, F.month(date))
    out = out.withColumn("_s", F.avg(F.col("_v") - F.col("trend")).over(by_month))
    # mean over the twelve calendar months, each counted once however often it occurs
    weight = F.lit(1.0) / F.count(F.lit(1)).over(by_month)
    out = out.withColumn("_w", weight)
    whole = Window.partitionBy(*keys)
    center = F.sum(F.col("_s") * F.col("_w")).over(whole) / F.sum("_w").over(whole)
    out = out.withColumn("seasonal", F.col("_s") - center)
    out = out.withColumn("resid", F.col("_v") - F.col("trend") - F.col("seasonal"))
    return out.drop("_v", "_s", "_w")


@lru_cache(maxsize=512)
def _kernel(n: int, window: int, first: int, last: int) -> np.ndarray:
    """Tricube weights of the positions 0..n-1 (columns) around first..last (rows)."""
    at = np.arange(first, last + 1, dtype=float)
    distance = np.abs(at[:, None] - np.arange(n, dtype=float)[None, :])
    q = min(window, n)
    reach = np.partition(distance, q - 1, axis=1)[:, q - 1] + max(window - n, 0) / 2.0
    ratio = np.clip(distance / np.maximum(reach[:, None], 1e-12), 0.0, 1.0)
    return (1.0 - ratio**3) ** 3


def _loess(y: np.ndarray, weights: np.ndarray, window: int, first: int, last: int) -> np.ndarray:
    """Locally weighted lines through the columns of ``y``, evaluated at first..last."""
    n = len(y)
    k = _kernel(n, window, first, last)
    x = np.arange(n, dtype=float)[:, None]
    at = np.arange(first, last + 1, dtype=float)[:, None]
    mass = k @ weights
    seen = mass > 1e-12
    mass = np.where(seen, mass, 1.0)
    mid = (k @ (weights * x)) / mass
    level = (k @ (weights * y)) / mass
    spread = (k @ (weights * x * x)) / mass - mid * mid
    joint = (k @ (weights * x * y)) / mass - mid * level
    slope = np.where(spread > 1e-9, joint / np.maximum(spread, 1e-9), 0.0)
    fallback = y[np.clip(at[:, 0], 0, n - 1).astype(int)]
    return np.where(seen, level + slope * (at - mid), fallback)


def _moving_mean(y: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(y, np.ones(width) / width, mode="valid")


def _odd_above(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def _months_apart(n: int, period: int) -> list[np.ndarray]:
    """Positions of the cycle sub-series, stacked by their length (at most two lengths)."""
    full, extra = divmod(n, period)
    stacks = []
    if extra:
        stacks.append(np.arange((full + 1) * period).reshape(full + 1, period)[:, :extra])
    if extra < period:
        stacks.append(np.arange(full * period).reshape(full, period)[:, extra:])
    return stacks


def stl_components(y: np.ndarray, period: int = PERIOD, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal-trend decomposition by loess of one short series: (trend, seasonal)."""
    n = len(y)
    trend_window = _odd_above(1.5 * period / (1.0 - 1.5 / seasonal))
    low_window = _odd_above(period + 1e-9)
    inner, outer = (2, 15) if robust else (5, 0)
    trend, season = np.zeros(n), np.zeros(n)
    weights, even = np.ones(n), np.ones((n, 1))
    stacks = _months_apart(n, period)
    for round_no in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            cycle = np.zeros(n + 2 * period)
            for at in stacks:
                rows = len(at)
                smooth = _loess(detrended[at], weights[at], seasonal, -1, rows)
                # position p of a sub-series is value p * period of the extended cycle, one period earlier
                where = np.vstack([at[0] - period, at, at[-1] + period]) + period
                cycle[where] = smooth
            low = _moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3)
            low = _loess(low[:, None], even, low_window, 0, n - 1)[:, 0]
            season = cycle[period:period + n] - low
            trend = _loess((y - season)[:, None], weights[:, None], trend_window, 0, n - 1)[:, 0]
        if round_no < outer:
            rest = np.abs(y - season - trend)
            limit = 6.0 * np.median(rest)
            if limit <= 1e-12:
                break
            weights = np.clip(1.0 - np.clip(rest / limit, 0.0, 1.0) ** 2, 0.0, 1.0) ** 2
    return trend, season


def stl(arrays: DataFrame, period: int = PERIOD, robust: bool = True, kind: str = "additive") -> DataFrame:
    """Adds ``trend``, ``seasonal`` and ``resid`` arrays; a series under two periods gets nulls.

    Loess with robustness weights has no built-in equivalent, so it runs in a
    vectorised function on Arrow batches, one short array per series.
    """
    schema = T.StructType([
        T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("trend", "seasonal", "resid")
    ])

    @F.pandas_udf(schema)
    def split(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for item in batch:
            y = np.asarray(item, dtype=float)
            if len(y) < 2 * period:
                rows.append((None, None, None))
                continue
            trend, season = stl_components(y, period, robust=robust)
            rows.append((trend, season, y - trend - season))
        return pd.DataFrame(rows, columns=["trend", "seasonal", "resid"])

    values = F.transform("values", lambda v: F.log1p(v)) if kind == "multiplicative" else F.col("values")
    return arrays.withColumn("_c", split(values)).select(
        *arrays.columns, "_c.trend", "_c.seasonal", "_c.resid",
    )


# --- trend forecasts -------------------------------------------------------------

def best_order(y: np.ndarray, d: int, max_p: int = 5) -> tuple[float, int, np.ndarray]:
    """Autoregression on the d-times differenced series with the lowest corrected AIC: (aicc, p, coefficients).

    All lengths predict the same trailing points, so their errors are comparable. Too few points give p = 0, and the
    mean of the differences up to d = 1 or none beyond.
    """
    z = np.diff(y, n=d) if d else y
    count = len(z) - max_p
    best = (np.inf, 0, np.array([z.mean()]) if d < 2 and len(z) else np.zeros(0))
    if count < max_p + 4:
        return best
    target = z[len(z) - count:]
    for p in range(max_p + 1):
        columns = [np.ones(count)] if d < 2 else []
        columns += [z[len(z) - count - k:len(z) - k] for k in range(1, p + 1)]
        if columns:
            design = np.column_stack(columns)
            coefficients, *_ = np.linalg.lstsq(design, target, rcond=None)
            error = target - design @ coefficients
        else:
            coefficients, error = np.zeros(0), target
        k = len(coefficients) + 1
        sse = max(float(error @ error), 1e-12)
        aicc = count * np.log(sse / count) + 2 * k + 2.0 * k * (k + 1) / (count - k - 1)
        if aicc < best[0] - 1e-9:
            best = (aicc, p, coefficients)
    return best


def project_order(y: np.ndarray, d: int, p: int, coefficients: np.ndarray, steps: int) -> np.ndarray:
    levels = [np.diff(y, n=i) if i else y for i in range(d + 1)]
    history = list(levels[d])
    for _ in range(steps):
        lagged = [history[-k] for k in range(1, p + 1)]
        terms = ([1.0] if d < 2 else []) + lagged
        history.append(float(np.dot(coefficients[: len(terms)], terms)) if terms and len(coefficients) else 0.0)
    ahead = np.asarray(history[len(levels[d]):])
    for i in range(d - 1, -1, -1):
        ahead = levels[i][-1] + np.cumsum(ahead)
    return ahead


def trend_search(df: DataFrame, column: str, steps: int, out: str = "trend_forecast") -> DataFrame:
    """Adds ``out`` (array of forecasts), ``d`` and ``p``.

    The order of differencing comes first, from the level test as a column expression; the length of the
    autoregression is searched for it. An empty or missing series is forecast as zero.
    """
    schema = T.StructType([T.StructField("forecast", T.ArrayType(T.DoubleType())), T.StructField("p", T.IntegerType())])

    @F.pandas_udf(schema)
    def search(series: pd.Series, orders: pd.Series) -> pd.DataFrame:
        rows = []
        for item, d in zip(series, orders):
            y = np.asarray(item if item is not None else [], dtype=float)
            if len(y) < 2:
                rows.append((np.repeat(y[-1] if len(y) else 0.0, steps), 0))
                continue
            d = min(int(d), len(y) - 1)
            _, p, coefficients = best_order(y, d)
            rows.append((project_order(y, d, p, coefficients, steps), p))
        return pd.DataFrame(rows, columns=["forecast", "p"])

    known = A.computed_once(df, d=F.coalesce(differences_needed(F.col(column)), F.lit(0)))
    return known.withColumn("_t", search(F.col(column), F.col("d"))).select(
        *df.columns, F.col("_t.forecast").alias(out), "d", F.col("_t.p").alias("p"))


def damped_fit(values: Column) -> Column:
    return holt_fit(values, DAMPING)


def damped_path(fit: Column, shrink: Column, steps: int) -> Column:
    """Damped trend whose negative slope is shrunk by its size relative to the level."""
    slope = F.when(
        fit["trend"] < 0,
        fit["trend"] * F.exp(-shrink * F.abs(fit["trend"]) / (F.abs(fit["level"]) + 1e-6)),
    ).otherwise(fit["trend"])
    return A.steps(
        steps, lambda h: fit["level"] + slope * (1.0 - F.pow(fit["phi"], h)) / (1.0 - fit["phi"]),
    )


def non_negative_path(values: Column, steps: int, last_n: int = 3, start: float = 1.5, limit: float = 10.0) -> Column:
    """Smallest shrink (in steps of one) whose last ``last_n`` months do not sum below zero.

    The largest shrink stands where none does; a path with a negative total becomes zero.
    """
    shrinks = []
    s = start
    while s < limit:
        shrinks.append(s)
        s += 1.0

    def build(fit: Column) -> Column:
        paths = F.array(*[damped_path(fit, F.lit(s), steps) for s in shrinks])
        passing = F.filter(paths, lambda p: A.total(A.tail(p, last_n)) >= 0)
        pick = F.coalesce(F.get(passing, F.lit(0)), F.get(paths, F.lit(len(shrinks) - 1)))
        return F.when(A.total(pick) < 0, F.array_repeat(F.lit(0.0), F.lit(steps))).otherwise(pick)

    return A.let(damped_fit(values), build)


def quiet_or_damped(forecast: Column, history: Column, last_two_years: Column, steps: int, shrink: float = 3.0) -> Column:
    """Zero after two silent years; damped instead when a never negative history is forecast below zero."""
    falls = (F.array_min(forecast) < 0) & (F.array_min(history) >= 0)
    damped = A.let(damped_fit(history), lambda f: damped_path(f, F.lit(shrink), steps))
    zero = F.array_repeat(F.lit(0.0), F.lit(steps))
    return F.when(last_two_years == 0, zero).when(falls, damped).otherwise(forecast)


# --- combination -----------------------------------------------------------------

def tile_season(seasonal: Column, steps: int) -> Column:
    """The last twelve seasonal values, repeated."""
    from .models import seasonal_naive
    return seasonal_naive(seasonal, steps)


def combine(trend: Column, seasonal: Column) -> Column:
    return F.zip_with(trend, seasonal, lambda t, s: t + s)


def zero_if_negative(values: Column) -> Column:
    """All zeros when the total is negative."""
    return F.when(A.total(values) < 0, F.transform(values, lambda _: F.lit(0.0))).otherwise(values)


def replace_negative(forecast: Column, last_actual: Column) -> Column:
    return F.when(forecast < 0, last_actual).otherwise(forecast)


def bounds(df: DataFrame, keys: list[str], date: str, forecast: DataFrame, z: float = DEFAULT_Z) -> DataFrame:
    """Monthly forecast with plus and minus ``z`` residual standard deviations of its series."""
    spread = df.groupBy(*keys).agg(F.stddev_samp("resid").alias("resid_std"))
    out = forecast.join(spread, keys)
    return out.withColumns({
        "lower": F.col("value") - F.lit(z) * F.col("resid_std"),
        "upper": F.col("value") + F.lit(z) * F.col("resid_std"),
    })


def yearly_bounds(df: DataFrame, keys: list[str], date: str, forecast: DataFrame, z: float = DEFAULT_Z) -> DataFrame:
    """Yearly forecast with the spread of yearly residual sums."""
    sums = df.where(F.col("resid").isNotNull()).groupBy(*keys, F.year(date).alias("year")).agg(F.sum("resid").alias("r"))
    spread = sums.groupBy(*keys).agg(F.stddev_samp("r").alias("resid_std"))
    total = forecast.groupBy(*keys, F.year("month").alias("year")).agg(F.sum("value").alias("value"))
    out = total.join(spread, keys)
    return out.withColumns({
        "lower": F.col("value") - F.lit(z) * F.col("resid_std"),
        "upper": F.col("value") + F.lit(z) * F.col("resid_std"),
    })


def sparse_mean(df: DataFrame, keys: list[str], date: str, measure: str, target_year: int) -> DataFrame:
    """Monthly value of a series too sparse to model: mean yearly sum of target-2..target over twelve.

    Years inside the series without rows count as zero, years outside do not count.
    """
    years = df.groupBy(*keys).agg(
        F.min(F.year(date)).alias("_a"), F.max(F.year(date)).alias("_b"),
        F.sum(F.when(F.year(date).between(target_year - 2, target_year), F.col(measure)).otherwise(0.0)).alias("_s"),
    )
    first = F.greatest(F.col("_a"), F.lit(target_year - 2))
    last = F.least(F.col("_b"), F.lit(target_year))
    count = F.greatest(last - first + 1, F.lit(0))
    value = F.coalesce(F.try_divide("_s", count), F.lit(0.0)) / 12.0
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_no")
    return years.select(*keys, value.alias("value"), months)
