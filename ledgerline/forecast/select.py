"""Holdout scoring, choice of one model per series, and its forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.series import eligibility, spread_series
from ..session import cut_lineage
from .models import DEFAULT_MODELS, REGISTRY, explode_steps, or_zero


def cut_at_year(arrays: DataFrame, target_year: int) -> DataFrame:
    """Histories as they stood before the target year began."""
    months = F.greatest(
        F.lit(0),
        F.least(
            F.size("values"),
            (F.lit(target_year) - F.year("first_month")) * 12 - F.month("first_month") + 1,
        ),
    )
    # month ends: adding months to the first month's end and snapping keeps calendar ends
    cut = arrays.withColumn("_n", months).where(F.col("_n") > 0)
    return cut.withColumns({
        "values": F.slice("values", F.lit(1), F.col("_n")),
        "last_month": F.last_day(F.add_months("first_month", F.col("_n") - 1)),
    }).drop("_n")


def last_months(arrays: DataFrame, months_back: int) -> DataFrame:
    """Only the trailing months of each history (``-1`` keeps all)."""
    if months_back == -1:
        return arrays
    kept = A.tail(F.col("values"), months_back)
    return arrays.withColumns({
        "values": kept,
        "first_month": F.last_day(F.add_months("last_month", 1 - F.size(kept))),
    })


def _yearly_mape(actual: Column, predicted: Column, first_part: Column, size: int) -> Column:
    """Mean absolute percentage error of calendar-year sums; the first year owns ``first_part`` months."""
    def part(values: Column, start: Column, count: Column) -> Column:
        return A.total(F.slice(values, start, count))

    rest = F.lit(size) - first_part
    one = _relative(part(actual, F.lit(1), first_part), part(predicted, F.lit(1), first_part))
    two = _relative(part(actual, first_part + 1, rest), part(predicted, first_part + 1, rest))
    return F.when(rest > 0, (one + two) / 2.0).otherwise(one)


def _relative(actual: Column, predicted: Column) -> Column:
    return F.try_divide(F.abs(actual - predicted), F.abs(actual))


def attach_models(arrays: DataFrame, by: str, sets: DataFrame, default: list[str] | None = None) -> DataFrame:
    """Adds ``allowed``, a map from model to its rank, out of a table of sets with ``by``, model and rank.

    Values of ``by`` without a set get the default one. A set is at most the registry, so the maps stay small.
    """
    known = F.when(F.col("model").isin(list(REGISTRY)), F.col("model")).otherwise(F.raise_error(F.concat(F.lit("unknown model "), "model")))
    packed = sets.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(known, F.col("rank").cast("int")))).alias("allowed"))
    usual = F.create_map(*[x for i, m in enumerate(default or DEFAULT_MODELS) for x in (F.lit(m), F.lit(i))])
    named = packed.withColumnRenamed(by, "_set_of")
    met = arrays.join(named, arrays[by].eqNullSafe(named["_set_of"]), "left").drop("_set_of")
    return met.withColumn("allowed", F.coalesce("allowed", usual))


def score_models(arrays: DataFrame, keys: list[str], models: list[str] | None = None, holdout: int = 12) -> DataFrame:
    """Adds ``scores``: one struct(score, rank, model) per model, on the last ``holdout`` months.

    With a column ``allowed`` (model to rank) a series is scored by its own models only; the others are not evaluated
    for it. Series shorter than two holdouts keep their row and have no scores.
    """
    by_series = "allowed" in arrays.columns
    names = models or (list(REGISTRY) if by_series else DEFAULT_MODELS)
    own = lambda name: F.try_element_at("allowed", F.lit(name))
    n = F.size("values")
    long_enough = n >= 2 * holdout
    split = spread_series(arrays, keys).select(
        "*",
        F.when(long_enough, F.slice("values", F.lit(1), F.greatest(n - holdout, F.lit(0)))).alias("_train"),
        A.tail(F.col("values"), holdout).alias("_test"),
        F.least(F.lit(holdout), F.lit(13) - F.month(F.add_months("last_month", 1 - holdout))).alias("_first_part"),
    )
    forecasts = split.select("*", *[
        F.when(own(name).isNotNull() if by_series else F.lit(True), REGISTRY[name](F.col("_train"), holdout)).alias(f"_f{i}")
        for i, name in enumerate(names)
    ])
    scores = [
        F.struct(
            _yearly_mape(F.col("_test"), F.col(f"_f{i}"), F.col("_first_part"), holdout).alias("score"),
            (own(name) if by_series else F.lit(i)).alias("rank"),
            F.lit(name).alias("model"),
        )
        for i, name in enumerate(names)
    ]
    listed = F.when(F.col("_train").isNotNull(), F.array(*scores))
    if by_series:
        listed = F.filter(listed, lambda s: s["rank"].isNotNull())
    return A.computed_once(forecasts, scores=listed).drop(
        "_train", "_test", "_first_part", *[f"_f{i}" for i in range(len(names))],
    )


def score_table(scored: DataFrame, keys: list[str]) -> DataFrame:
    rows = scored.select(*keys, F.explode_outer("scores").alias("_s")).where(F.col("_s").isNotNull())
    return rows.select(*keys, "_s.model", "_s.score")


def choose(scored: DataFrame, direction: str = "min") -> DataFrame:
    """Adds ``winner``: the model with the lowest (or, on request, highest) score; null scores never win.

    Ties go to the model listed first.
    """
    usable = F.filter("scores", lambda s: s["score"].isNotNull() & ~F.isnan(s["score"]))
    if direction == "min":
        best = F.array_min(usable)
    else:
        flipped = F.transform(usable, lambda s: F.struct(
            (-s["score"]).alias("score"), s["rank"].alias("rank"), s["model"].alias("model")))
        top = F.array_min(flipped)
        best = F.struct((-top["score"]).alias("score"), top["rank"].alias("rank"), top["model"].alias("model"))
    return scored.withColumn("winner", best)


def winners(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Winner table: series, model, score."""
    return chosen.where(F.col("winner").isNotNull()).select(
        *keys, F.col("winner.model").alias("model"), F.col("winner.score").alias("score"),
    )


def forecast_winner(chosen: DataFrame, keys: list[str], steps: int, models: list[str] | None = None) -> DataFrame:
    """Forecast of each series by its winner only; the others are not evaluated for it.

    A series without a winner has one row with nothing but its keys.
    """
    names = models or (list(REGISTRY) if "allowed" in chosen.columns else DEFAULT_MODELS)
    chain = None
    for name in names:
        values = or_zero(REGISTRY[name])(F.col("values"), steps)
        hit = F.col("winner.model") == name
        chain = F.when(hit, values) if chain is None else chain.when(hit, values)
    ahead = chosen.select(*keys, "last_month", F.col("winner.model").alias("model"), chain.alias("_f"))
    return explode_steps(ahead, keys, "_f", ["model"], keep_empty=True)


def reconciled_run(
    arrays: DataFrame, keys: list[str], steps: int, target_year: int, models=None, holdout=12, direction="min", months_back=-1,
) -> tuple[DataFrame, DataFrame]:
    """(forecast, bad): every series is in exactly one of the two.

    Bad series are short, silent in the last two holdouts or stopped before the year ahead of the target, and those
    no model could score; ``reason`` says which. The scores are worked out once and written.
    """
    judged = eligibility(arrays, target_year, holdout)
    scored = choose(score_models(judged.where(~F.col("is_bad")).drop("is_bad"), keys, models, holdout), direction)
    chosen = cut_lineage(scored.drop("scores"))
    forecast = forecast_winner(last_months(chosen.where(F.col("winner").isNotNull()), months_back), keys, steps, models)
    bad = judged.where("is_bad").select(*keys, F.lit("not eligible").alias("reason"))
    return forecast, bad.unionByName(chosen.where(F.col("winner").isNull()).select(*keys, F.lit("no score").alias("reason")))


def quarterly_run(arrays: DataFrame, keys: list[str], steps: int, models=None, holdout=12, direction="min", months_back=-1) -> DataFrame:
    """Score, choose and forecast in one plan. Every series comes out: one that no model could score as a row of its keys alone."""
    chosen = choose(score_models(arrays, keys, models, holdout), direction)
    return forecast_winner(last_months(chosen, months_back), keys, steps, models)
