"""Quarterly many-series run: budget rows to labelled monthly series, and change pairs to net amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..forecast import select
from ..forecast.models import PAIR_MODELS
from ..functions.labels import keep_for_labelling, label_column, rules_for
from ..functions.scalars import month_end, parse_amount
from ..operators import aggregates, joins, series, windows
from ..schemas import MONTH_COLUMNS

BUDGET_IDS = ["financial_year", "economy", "expenditure_type", "doc_type", "fund_code", "fingroup", "law"]


def budget_long(wide: DataFrame) -> DataFrame:
    """Twelve month columns to rows, amounts parsed, dated at the month end."""
    long = aggregates.melt(wide, BUDGET_IDS, MONTH_COLUMNS, "month_no", "volume")
    dated = long.where(F.col("financial_year").isNotNull())
    return dated.select(
        *BUDGET_IDS, month_end("financial_year", F.col("month_no").cast("int")).alias("month"),
        parse_amount("volume").alias("volume"))


def labelled(long: DataFrame, coin: int) -> DataFrame:
    return long.where(keep_for_labelling(coin)).withColumn("type", label_column(rules_for(coin)))


def type_series(rows: DataFrame) -> DataFrame:
    """Dense monthly sums per (type, fingroup)."""
    return series.densify(rows, ["type", "fingroup"], "month", "volume")


def year_to_date(monthly: DataFrame) -> DataFrame:
    keyed = monthly.withColumn("_y", F.year("month"))
    out = windows.running_sum(keyed, ["type", "fingroup", "_y"], ["month"], "volume", "ytd")
    return out.drop("_y")


def model_sets(spark: SparkSession, sets: dict[str, list[str]]) -> DataFrame:
    """The model sets by type as a table (type, model, rank): a few rows per type."""
    rows = [(name, model, rank) for name, models in sets.items() for rank, model in enumerate(models)]
    return spark.createDataFrame(rows, "type string, model string, rank int")


def forecast_types(monthly: DataFrame, steps: int, sets: DataFrame | None = None) -> DataFrame:
    """Every (type, fingroup) forecast by its own best model out of the set of its type.

    ``sets`` is a table (type, model, rank); types it does not name choose among the default models, and the lower
    rank wins a tie. A series that no model could score has a row of its keys alone.
    """
    keys = ["type", "fingroup"]
    arrays = series.as_arrays(monthly, keys, "month", "volume")
    if sets is not None:
        arrays = select.attach_models(arrays, "type", sets)
    return select.quarterly_run(arrays, keys, steps)


def change_pairs(lines: DataFrame) -> DataFrame:
    """Document lines 1 and 2 as (out, in) pairs with the second amount, incomplete pairs dropped."""
    kept = lines.where(~F.col("fund_code").eqNullSafe(F.lit(1410))).withColumn("value", parse_amount("110"))
    pairs = joins.pair_lines(kept, "doc_id", "doc_item", "MOF_class", ["value", "year", "month", "law"])
    return pairs.dropna(subset=["class_out", "class_in", "value", "year", "month", "law"])


def pair_series(pairs: DataFrame) -> DataFrame:
    dated = pairs.withColumn("date", month_end("year", "month"))
    return series.fill_common_span(dated, ["class_out", "class_in"], "date", "value")


def forecast_pairs(monthly: DataFrame, steps: int) -> DataFrame:
    keys = ["class_out", "class_in"]
    arrays = series.as_arrays(monthly, keys, "month", "value")
    return select.quarterly_run(arrays, keys, steps, PAIR_MODELS)


def net_forecast(forecast: DataFrame) -> DataFrame:
    """Forecast per party and month: what leaves it minus what enters it, by side."""
    known = forecast.where(F.col("month").isNotNull())
    return aggregates.net_by_side(known, "class_out", "class_in", "value", ["month"])
