"""Document preparation and the global cross-series forecast.

Documents have ``doc``, ``group``, ``year``, ``month``, ``volume`` and, for
orders and funds, ``fund_year``.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.labels import FUND_DOC_CODES, FUND_DOC_MERGES, INVOICE_DOC_MERGES, merge_codes
from ..functions.scalars import hash_normal
from ..operators import aggregates, evaluate, series, windows
from ..session import cut_lineage

GROUP = ["doc", "group"]
STEPS = 12


def merge_fund_docs(funds: DataFrame) -> DataFrame:
    kept = funds.where(F.col("doc").cast("int").isin(FUND_DOC_CODES))
    return kept.withColumn("doc", merge_codes(F.col("doc").cast("int"), FUND_DOC_MERGES).cast("string"))


def merge_invoice_docs(invoices: DataFrame) -> DataFrame:
    return invoices.withColumn("doc", merge_codes("doc", INVOICE_DOC_MERGES))


def effective_dates(df: DataFrame) -> DataFrame:
    """Value of a later fund year flows from January of that year."""
    later = F.col("year") < F.col("fund_year")
    return df.withColumns({
        "month": F.when(later, F.lit(1)).otherwise(F.col("month")),
        "year": F.when(later, F.col("fund_year")).otherwise(F.col("year")),
    }).drop("fund_year")


def unique_rows(df: DataFrame) -> DataFrame:
    return aggregates.collapse(df, "volume")


def accumulate(df: DataFrame) -> DataFrame:
    """Running volume per series; expects one row per (series, month)."""
    return windows.running_sum(df, GROUP, ["year", "month"], "volume", "_run").drop("volume").withColumnRenamed("_run", "volume")


def clip_to(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows from the other table's first year to its last (year, month)."""
    at = F.col("year") * 12 + F.col("month")
    first = other.agg(F.min("year")).scalar()
    last = other.agg(F.max(at)).scalar()
    return df.where((F.col("year") >= first) & (at <= last))


def prepare(df: DataFrame, invoices: DataFrame) -> DataFrame:
    return clip_to(accumulate(unique_rows(effective_dates(df))), invoices)


def combine(invoices: DataFrame, orders: DataFrame, funds: DataFrame) -> DataFrame:
    return (
        merge_invoice_docs(invoices)
        .unionByName(prepare(orders, invoices))
        .unionByName(prepare(merge_fund_docs(funds), invoices))
    )


def sequence_input(docs: DataFrame, target_year: int, threshold: float) -> DataFrame:
    """Sums per (series, month) of series large enough, up to the target year, over the common span."""
    upto = docs.where(F.col("year") <= target_year)
    # months per series are few beside the documents; written once, read by the threshold, the span and the fill
    months = cut_lineage(upto.groupBy(*GROUP, "year", "month").agg(F.sum("volume").alias("volume")))
    large = aggregates.keep_groups_above(months, GROUP, "year", "volume", threshold)
    dated = large.withColumn("date", F.last_day(F.make_date("year", "month", F.lit(1))))
    return series.fill_common_span(dated, GROUP, "date", "volume")


def lag_table(scaled: DataFrame, keys: list[str], noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Scaled value with the twelve before it and the calendar month; optional input noise."""
    rows = windows.lags(scaled, keys, ["month"], "scaled", tuple(range(1, STEPS + 1)))
    rows = rows.dropna(subset=[f"scaled_lag_{STEPS}"]).withColumn("month_no", F.month("month"))
    if noise:
        rows = rows.withColumns({
            f"scaled_lag_{k}": F.col(f"scaled_lag_{k}") + noise * hash_normal(*keys, "month", seed=seed + k)
            for k in range(1, STEPS + 1)
        })
    return rows.withColumn("series_key", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


# What tells series apart: numbers of their training years, so no two share a value unless they are alike.
PROFILE = ["level", "spread", "slope", "season_cos", "season_sin"]
PACE_KEPT = 0.8


def _features() -> list[str]:
    return [f"scaled_lag_{k}" for k in range(1, STEPS + 1)] + ["month_no", "pace", *PROFILE]


def pack_series(scaled: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: months and scaled ``values`` in order, bounds of the scale, profile and ``paces``.

    The profile is mean, spread, slope per year and the first yearly wave of the values. The pace is how far the year
    runs ahead of the one before, faded month by month; ``paces`` holds it as known before the 13th month and every
    later one, and last as known after all of them. Series under a year drop out.
    """
    packed = scaled.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("month", "scaled"))).alias("_o"), F.max("low").alias("low"), F.max("high").alias("high"),
    ).where(F.size("_o") >= STEPS)
    packed = packed.select(*keys, "low", "high", F.col("_o.month").alias("months"), F.col("_o.scaled").alias("values"))
    n, values = F.size("values"), F.col("values")
    angle = lambda m: F.month(m) * F.lit(2 * math.pi / 12)
    wave = lambda fn: A.total(F.zip_with("values", "months", lambda v, m: v * fn(angle(m)))) * 2 / n
    mid = (n - 1) / 2.0
    out = packed.withColumn("level", A.mean(values)).withColumns({
        "spread": F.sqrt(A.total(F.transform(values, lambda v: F.pow(v - F.col("level"), 2))) / n),
        "slope": F.coalesce(F.try_divide(A.total(F.transform(values, lambda v, i: v * (i - mid))), n * (n * n - 1) / 12.0), F.lit(0.0)) * 12,
        "season_cos": wave(F.cos), "season_sin": wave(F.sin),
    })

    def step(state, t):
        gap = F.get("values", t) - F.get("values", t - STEPS)
        return A.let(_next_pace(F.element_at(state, -1), gap), lambda p: F.concat(state, F.array(p)))

    return out.withColumn("paces", F.aggregate(A.positions(STEPS, n - 1), F.array(F.lit(0.0)), step))


def _next_pace(pace, gap):
    return F.lit(PACE_KEPT) * pace + F.lit(1 - PACE_KEPT) * gap


def sequence_rows(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Training rows: each month from the 13th on with the twelve before it, the pace so far and the series' profile."""
    def row(t):
        lags = [F.get("values", t - k).alias(f"scaled_lag_{k}") for k in range(1, STEPS + 1)]
        return F.struct(F.get("months", t).alias("month"), F.get("values", t).alias("scaled"), F.get("paces", t - STEPS).alias("pace"), *lags)

    rows = packed.select(*keys, *PROFILE, F.explode(F.transform(A.positions(STEPS, F.size("values") - 1), row)).alias("_r"))
    return rows.select(*keys, *PROFILE, "_r.*").withColumn("month_no", F.month("month"))


def with_noise(rows: DataFrame, keys: list[str], noise: float, replicas: int, seed: int = 0) -> DataFrame:
    """``replicas`` copies of each row, each with its own draws of N(0, noise) on all lags; the same seed draws the same."""
    copies = rows.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
    drawn = {
        f"scaled_lag_{k}": F.col(f"scaled_lag_{k}") + F.lit(noise) * hash_normal(*keys, "month", "replica", seed=seed + 7_919 * k)
        for k in range(1, STEPS + 1)
    }
    return copies.withColumns(drawn).drop("replica")


def fit_sequence(rows: DataFrame, keys: list[str], trees: int = 20, depth: int = 4, noise: float = 0.0, replicas: int = 4, seed: int = 0):
    """One boosted-tree model over all series; with ``noise`` it learns from noisy replicas of the rows."""
    made = with_noise(rows, keys, noise, replicas, seed) if noise else rows
    packed = VectorAssembler(inputCols=_features(), outputCol="features").transform(made)
    model = GBTRegressor(labelCol="scaled", maxIter=trees, maxDepth=depth, seed=seed)
    return model.fit(packed.select("features", "scaled"))


def next_inputs(packed: DataFrame, keys: list[str]) -> DataFrame:
    """State of every series before the month after its last: lags, pace, profile."""
    lags = [F.element_at("values", F.lit(-k)).alias(f"scaled_lag_{k}") for k in range(1, STEPS + 1)]
    month = F.month(F.add_months(F.element_at("months", -1), 1)).alias("month_no")
    return packed.select(*keys, "low", "high", F.element_at("months", -1).alias("last_month"), *PROFILE, F.element_at("paces", -1).alias("pace"), month, *lags)


def roll_sequence(model, start: DataFrame, steps: int, seed_months: int = 0) -> DataFrame:
    """``path``: ``steps`` scaled values of each series, those below 0 shown as 0.

    ``start`` has one row per series as from ``next_inputs``, and for a seed the array ``seed`` of known values. The
    first ``seed_months`` steps take these in place of the prediction: they warm up lags and pace, and months the
    array lacks are predicted. What is fed back is the prediction itself. Every step is a narrow projection.
    """
    assemble = VectorAssembler(inputCols=_features(), outputCol="features")
    moving = {"pace", "month_no", *[f"scaled_lag_{k}" for k in range(1, STEPS + 1)]}
    state, made = start, []
    for h in range(1, steps + 1):
        state = model.transform(assemble.transform(state))
        value = F.coalesce(F.get("seed", F.lit(h - 1)), F.col("prediction")) if h <= seed_months else F.col("prediction")
        state = state.withColumn(f"_y{h}", value).drop("features", "prediction")
        moved = {f"scaled_lag_{k}": F.col(f"scaled_lag_{k - 1}") for k in range(2, STEPS + 1)}
        moved["scaled_lag_1"] = F.col(f"_y{h}")
        moved["pace"] = _next_pace(F.col("pace"), F.col(f"_y{h}") - F.col(f"scaled_lag_{STEPS}"))
        moved["month_no"] = F.pmod(F.col("month_no"), F.lit(12)) + 1
        state = state.withColumns(moved)
        made.append(f"_y{h}")
    static = [c for c in start.columns if c not in moving]
    return state.select(*static, F.transform(F.array(*made), lambda y: F.greatest(y, F.lit(0.0))).alias("path"))


def sequence_months(docs: DataFrame, target_year: int, threshold: float, keys: list[str] = GROUP, seed_months: int = 0, **settings) -> DataFrame:
    """keys, month, known and value: the target year and the one after it, month by month, for every series.

    The model learns from the full years before the target year. The first ``seed_months`` of the target year are
    known and carry the state into the rest; the next year goes on from the twelve months before it. Known values
    below the smallest of the training years show as that, like forecasts.
    """
    months = sequence_input(docs, target_year, threshold)
    before = months.where(F.year("month") < target_year)
    complete = aggregates.full_years(
        before.withColumns({"year": F.year("month"), "month_no": F.month("month")}), keys, "year", "month_no").drop("year", "month_no")
    # one row per series; written once for the many passes of the fit
    packed = cut_lineage(pack_series(series.min_max_scale(complete, keys, "volume"), keys))
    model = fit_sequence(sequence_rows(packed, keys), keys, **settings)
    start = next_inputs(packed, keys)
    first = months.where((F.year("month") == target_year) & (F.month("month") <= seed_months))
    known = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "volume"))), lambda o: o["volume"]).alias("_seed"))
    scale = F.transform("_seed", lambda v: F.coalesce(F.try_divide(v - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)))
    seeded = start.join(known, keys, "left").withColumn("seed", F.coalesce(scale, F.array().cast("array<double>"))).drop("_seed")
    path = roll_sequence(model, seeded, 2 * STEPS, seed_months)
    rows = path.select(*keys, "low", "high", F.size("seed").alias("_known"), F.posexplode("path").alias("_p", "_y"))
    month = F.last_day(F.add_months(F.make_date(F.lit(target_year), F.lit(1), F.lit(1)), F.col("_p")))
    return rows.select(*keys, month.alias("month"), (F.col("_p") < F.col("_known")).alias("known"), series.unscale("_y").alias("value"))


def sequence_forecast(docs: DataFrame, target_year: int, threshold: float, keys: list[str] = GROUP, seed_months: int = 0, **settings) -> DataFrame:
    """keys, year, forecast, actual, abs_err, rel_err for the target year and the next, both beside the target year's actual."""
    months = sequence_months(docs, target_year, threshold, keys, seed_months, **settings)
    ahead = months.groupBy(*keys, F.year("month").alias("year")).agg(F.sum("value").alias("forecast"))
    actual = docs.where(F.col("year") == target_year).groupBy(*keys).agg(F.sum("volume").alias("actual"))
    return evaluate.yearly_errors(ahead.join(actual, keys, "left").fillna(0.0, ["actual"]))
