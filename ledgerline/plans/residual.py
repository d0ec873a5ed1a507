"""Residual part of the revenue forecast: the shares of order attributes in the month's residual, summed over the attributes."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..forecast import decompose as D
from ..functions.scalars import month_end_of
from ..operators import series
from ..operators.windows import lags
from .spend import registered

LAGS = (1, 3, 6, 12)
MIN_ROWS = 10
MIN_RESIDUALS = 24


def decomposition_residuals(payments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, month, ``amount`` and ``resid``: what the classical decomposition of the dense series leaves over."""
    months = series.from_arrays(series.as_arrays(payments, keys, "payment_date", "amount"), keys, "month", "amount")
    return D.classical(months, keys, "month", "amount").drop("trend", "seasonal")


def gated(residuals: DataFrame, keys: list[str], doc_type: str = "RV", more_than: int = MIN_RESIDUALS) -> DataFrame:
    """Residuals of the keys that get a residual part: one document type, enough months that are not zero."""
    kept = residuals.where(F.col("doc_type") == doc_type)
    enough = kept.where(F.abs("resid") > 1e-6).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than)
    return kept.join(enough.select(*keys), keys, "left_semi")


def feature_months(payments: DataFrame, orders: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Monthly payments by key, order attribute (``feature``) and its ``value``; orders without an attribute drop out of that one.

    Payments are summed by order and meet one row per order that carries the
    first non-null value of every attribute, so all attributes cost one join.
    """
    monthly = registered(payments).groupBy(*keys, "order_id", month_end_of("payment_date").alias("month")).agg(
        F.sum("amount").alias("amount"))
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct("starting_date", f))).cast("string").alias(f"_{f}") for f in features]
    known = monthly.join(orders.groupBy("order_id").agg(*first), "order_id")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_{f}").alias("value")) for f in features]))
    long = known.select(*keys, "month", "amount", cells.alias("_c")).where(F.col("_c.value").isNotNull())
    return long.groupBy(*keys, "_c.feature", "_c.value", "month").agg(F.sum("amount").alias("feature_amount"))


def share_table(feature_rows: DataFrame, residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each attribute value in the month and in its residual, with lags per value.

    ``residuals`` has keys, month, ``resid`` and ``amount``. Lags go back over
    the months a value has rows in. A value of one key has at most one row per month.
    """
    joined = feature_rows.join(residuals.select(*keys, "month", "resid", "amount"), [*keys, "month"], "left")
    shared = joined.withColumn("share", F.try_divide("feature_amount", F.nullif("amount", F.lit(0.0))))
    shared = shared.withColumn("resid_share", F.col("resid") * F.col("share"))
    lagged = lags(shared, [*keys, "feature", "value"], ["month"], "resid_share", LAGS)
    lagged = lagged.withColumns({"month_no": F.month("month"), "year": F.year("month")})
    return lagged.dropna(subset=["share", "resid_share", *[f"resid_share_lag_{k}" for k in LAGS]])


def usable_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Attributes of a key with enough rows, a varying target and more than one value."""
    return table.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("resid_share").alias("_a"), F.max("resid_share").alias("_b"),
        F.min("value").alias("_f"), F.max("value").alias("_g"),
    ).withColumn("usable", (F.col("rows") >= MIN_ROWS) & (F.col("_a") < F.col("_b")) & (F.col("_f") < F.col("_g"))).drop(
        "_a", "_b", "_f", "_g")


def _columns() -> list[str]:
    return [f"resid_share_lag_{k}" for k in LAGS] + ["month_no", "year", "value_level", "key_level", "key_spread"]


def _with_levels(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A key's attribute and its values as numbers: the mean, and for keys the spread, of their shares in ``table``."""
    of_key = table.groupBy(*keys, "feature").agg(F.avg("resid_share").alias("key_level"), F.coalesce(F.stddev_samp("resid_share"), F.lit(0.0)).alias("key_spread"))
    of_value = table.groupBy("feature", "value").agg(F.avg("resid_share").alias("value_level"))
    return df.join(of_key, [*keys, "feature"], "left").join(of_value, ["feature", "value"], "left").fillna(0.0, ["key_level", "key_spread", "value_level"])


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=_columns(), outputCol="features").transform(df)


def _of_usable(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(usable_keys(table, keys).where("usable").select(*keys, "feature"), [*keys, "feature"], "left_semi")


def fit(table: DataFrame, keys: list[str], trees: int = 500, depth: int = 5, rate: float = 0.05, seed: int = 0):
    """One boosted-tree model for all keys and attributes, on the rows of usable ones; None if there are none."""
    rows = _assembled(_with_levels(_of_usable(table, keys), table, keys))
    if rows.isEmpty():
        return None
    return GBTRegressor(labelCol="resid_share", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(rows)


def states(table: DataFrame, residuals: DataFrame, keys: list[str], per_value: bool = False) -> DataFrame:
    """Where the roll-forward starts: the latest row of each usable attribute of a key, or of each of its values.

    ``_mean`` and ``_std`` are those of the key's residual.
    """
    by = [*keys, "feature", "value"] if per_value else [*keys, "feature"]
    rest = [c for c in ("value", "month_no", "year", *[f"resid_share_lag_{k}" for k in LAGS]) if c not in by]
    order = F.struct("month") if per_value else F.struct("month", "value")
    latest = _of_usable(table, keys).groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")
    spread = residuals.groupBy(*keys).agg(F.avg("resid").alias("_mean"), F.stddev_samp("resid").alias("_std"))
    return latest.join(spread, keys)


def roll_forward(model, table: DataFrame, residuals: DataFrame, keys: list[str], first_month: str, steps: int = 12, clip: float = 1.0, per_value: bool = False) -> DataFrame:
    """(keys, feature, value, month, resid_part): expected shares of every state, rolled on its own predictions.

    Predictions stay within ``clip`` standard deviations of the key's mean
    residual and within two of the one before. The steps are one projection over
    rows that hold their state, so the horizon adds no shuffle.
    """
    state = _with_levels(states(table, residuals, keys, per_value), table, keys)
    made = []
    for h in range(steps):
        at = F.add_months(F.lit(first_month).cast("date"), h)
        state = model.transform(_assembled(state)) if model is not None else state.withColumns({"features": F.lit(None), "prediction": F.lit(0.0)})
        low, high = F.col("_mean") - clip * F.col("_std"), F.col("_mean") + clip * F.col("_std")
        bounded = F.least(F.greatest("prediction", low), high)
        last = F.col("resid_share_lag_1")
        jump = 2.0 * F.col("_std")
        state = state.withColumn(f"_y{h}", F.least(F.greatest(bounded, last - jump), last + jump)).drop("features", "prediction")
        previous = dict(zip(LAGS[1:], LAGS[:-1]))
        moved = {f"resid_share_lag_{k}": F.col(f"resid_share_lag_{p}") for k, p in previous.items()}
        moved |= {"resid_share_lag_1": F.col(f"_y{h}"), "month_no": F.month(at), "year": F.year(at)}
        state = state.withColumns(moved)
        made.append(f"_y{h}")
    rows = state.select(*keys, "feature", "value", F.posexplode(F.array(*made)).alias("_p", "resid_part"))
    return rows.withColumn("month", F.last_day(F.add_months(F.lit(first_month).cast("date"), F.col("_p")))).drop("_p")


def total_by_month(ahead: DataFrame, residuals: DataFrame, keys: list[str], first_month: str, steps: int = 12) -> DataFrame:
    """Sum over attributes and their states for every key of ``residuals``; what has no model adds zero."""
    months = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda h: F.last_day(F.add_months(F.lit(first_month).cast("date"), h)))
    grid = residuals.select(*keys).distinct().withColumn("month", F.explode(months))
    sums = ahead.groupBy(*keys, "month").agg(F.sum("resid_part").alias("value"))
    return grid.join(sums, [*keys, "month"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
