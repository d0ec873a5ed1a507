"""Purchase-order track: preparation, training table, tree forest, roll-forward.

All heavy steps are keyed by (doc_id, fund_year, item). Invoices and edits are
summed per month and packed into calendar-bounded runs per order, so orders,
invoices and edits meet once on that key and the age windows reuse its partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import KEY
from ..functions.scalars import (
    absolute_month, compact_month, compact_year, equal_width_bin, hash_uniform, key_year, parse_amount, relative_month,
)
from ..operators import aggregates, joins, ranking
from ..session import cut_lineage
from .forest import fit_trees, load_trees, numbers, save_trees

VOLUMES = ["RE", "ZF", "ZY"]
ATTRIBUTES = ["po_type", "huka", "porcurment_organization", "expanditure_type", "fingroup"]
FULL_BALANCE = 0.98
MAX_AGE = 120


@dataclass(frozen=True)
class Features:
    """Feature lists by kind; each has its own default."""

    categorical: list[str] = field(default_factory=lambda: [
        "po_type", "huka", "porcurment_organization", "expanditure_type", "fingroup", "po_net_value_category"])
    integer: list[str] = field(default_factory=lambda: ["age", "N", "quarter"])
    floating: list[str] = field(default_factory=lambda: ["cumulative_portion"])

    def all(self) -> list[str]:
        return self.categorical + self.integer + self.floating


def prepare_keys(df: DataFrame) -> DataFrame:
    """Fund year to its four digits, key columns to text."""
    out = df.withColumn("fund_year", key_year("fund_year"))
    return out.withColumns({k: F.col(k).cast("string") for k in KEY})


def prepare_orders(orders: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per key with its first date; only positive values."""
    orders = prepare_keys(orders).withColumn("po_net_value", parse_amount("po_net_value"))
    merged = aggregates.consolidate(orders, KEY, ATTRIBUTES, "po_net_value")
    dated = joins.attach_dates(merged, prepare_keys(dates), KEY)
    return dated.where(F.col("po_net_value") > 0)


def with_features(orders: DataFrame, bins: int = 10) -> DataFrame:
    """Lag of the fund year, quarter, and the equal-width bin of the log value."""
    log_value = F.ln("po_net_value")
    low = orders.agg(F.min(log_value)).scalar()
    high = orders.agg(F.max(log_value)).scalar()
    return orders.withColumns({
        "N": F.col("fund_year").cast("int") - F.col("order_year"),
        "quarter": F.quarter("order_date"),
        "po_net_value_category": equal_width_bin(log_value, low, high, bins),
    })


def prepare_edits(edits: DataFrame) -> DataFrame:
    """Edit month from its compact date text."""
    out = prepare_keys(edits)
    return out.withColumn("edit_abs", absolute_month(compact_year("order_date"), compact_month("order_date")))


def prepare_invoices(invoices: DataFrame) -> DataFrame:
    """Invoices summed to (key, month) before any join."""
    return aggregates.sum_by(prepare_keys(invoices), KEY + ["invoice_year", "invoice_month"], *VOLUMES)


def invoice_history(orders: DataFrame, monthly_invoices: DataFrame) -> DataFrame:
    """Volume per (key, relative month); an order without invoices has a zero in month 0."""
    joined = joins.orders_with_invoices(monthly_invoices, orders, KEY, VOLUMES)
    timed = joined.withColumns({
        "rel_month": relative_month("invoice_year", "invoice_month", "order_year", "order_month"),
        "volume": sum((F.col(v) for v in VOLUMES), F.lit(0.0)),
    })
    return timed.groupBy(*KEY, "rel_month").agg(F.sum("volume").alias("volume"))


@dataclass(frozen=True)
class Prepared:
    """Orders with features, volume history and edits, ready for training and inference."""

    orders: DataFrame
    history: DataFrame
    edits: DataFrame
    invoices: DataFrame


def prepare(orders: DataFrame, dates: DataFrame, invoices: DataFrame, edits: DataFrame) -> Prepared:
    """Prepare all four tables. Orders and history are written once: the binning bounds, the
    longest history, training and inference each read them again."""
    clean = cut_lineage(prepare_orders(orders, dates))
    monthly = prepare_invoices(invoices)
    history = cut_lineage(invoice_history(clean, monthly))
    return Prepared(with_features(clean), history, prepare_edits(edits), monthly)


def smoothed_blocks(history: DataFrame, window: int) -> DataFrame:
    """Mean volume per block of ``window`` relative months.

    The last block of the whole table may be shorter, so the largest relative
    month (a scalar subquery) sets its size. Blocks without invoices have no row.
    """
    longest = history.agg(F.max("rel_month")).scalar()
    block = F.floor(F.col("rel_month") / window).cast("int")
    size = F.least(F.lit(window), longest + 1 - block * window)
    return history.groupBy(*KEY, block.alias("block"), size.alias("_size")).agg(
        (F.sum("volume") / F.col("_size")).alias("smoothed")).drop("_size")


def _runs(df: DataFrame, position: str, *columns: Column) -> Column:
    """Rows of an order as one array by position, each with the position of the next as ``until``."""
    return F.sort_array(F.collect_list(F.struct(position, "until", *columns)))


def edit_runs(changes: DataFrame) -> DataFrame:
    """Per order the months (``rel`` up to ``until``) in which its value stays the same, and that value."""
    w = Window.partitionBy(*KEY).orderBy("rel")
    summed = changes.withColumns({"value": F.sum("v").over(w), "until": F.lead("rel").over(w)})
    return summed.groupBy(*KEY).agg(_runs(summed, "rel", F.col("value")).alias("_edits"))


def payment_runs(blocks: DataFrame, window: int) -> DataFrame:
    """Per order the start of each paid block, its monthly mean and what the blocks before it add up to."""
    w = Window.partitionBy(*KEY).orderBy("start")
    placed = blocks.select(*KEY, (F.col("block") * window).alias("start"), "smoothed")
    whole = F.sum(F.col("smoothed") * window).over(w) - F.col("smoothed") * window
    summed = placed.withColumns({"before": whole, "until": F.lead("start").over(w)})
    return summed.groupBy(*KEY).agg(_runs(summed, "start", F.col("smoothed"), F.col("before")).alias("_paid"))


def with_ages(df: DataFrame, months: Column, window: int) -> DataFrame:
    """One row per age below ``months`` with the order's value at it (0 before the first edit: no row), what is paid at it
    (``_now``) and before it (``_before``).

    Runs of payments and of edits are laid out against each other first, so a row per age is made only where both are
    the same, by a plain sequence.
    """
    fields = "array<struct<start:int,until:int,smoothed:double,before:double>>"
    zero = F.lit(0.0)
    unpaid = F.array(F.struct(F.lit(0), F.get("_paid", F.lit(0))["start"], zero, zero)).cast(fields)
    paid = F.concat(unpaid, F.coalesce(F.col("_paid").cast(fields), F.array().cast(fields)))
    kept = [c for c in df.columns if c not in ("_edits", "_paid")]
    runs = df.select(*kept, "_edits", F.explode(paid).alias("_p")).select("*", F.explode("_edits").alias("_e")).where(F.col("_e.value") > 0)
    low = F.greatest(F.col("_p.start"), F.col("_e.rel"))
    high = F.least(F.col("_p.until"), F.col("_e.until"), months)  # a run without an end goes on
    met = runs.select(*kept, "_p", "_e", low.alias("_low"), high.alias("_high")).where(F.col("_low") < F.col("_high"))
    aged = met.select(*kept, "_p", "_e", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("age"))
    since = F.col("age") - F.col("_p.start")
    return aged.select(
        *kept, "age", F.col("_e.value").alias("_value"), F.when(since < window, F.col("_p.smoothed")).otherwise(zero).alias("_now"),
        (F.col("_p.before") + F.col("_p.smoothed") * F.least(since, F.lit(window))).alias("_before"))


def training_table(
    orders: DataFrame, history: DataFrame, edits: DataFrame, curr_year: int, curr_month: int,
    smoothing_window: int = 1, sample_frac: float = 1.0, seed: int = 0, max_years: int = 10,
) -> DataFrame:
    """One row per (order, age): value as edited by then, portion paid before, share of the balance paid at it.

    Sampling is two-staged like the copies it stands for: orders by the root of
    the fraction, then an age with the chance that one of its copies is drawn.
    """
    root = sample_frac**0.5
    if sample_frac < 1:
        orders = orders.where(hash_uniform(*KEY, seed=seed) < root)
    order_abs = absolute_month("order_year", "order_month")
    by_edit = edits.join(orders.select(*KEY, order_abs.alias("order_abs")), KEY).where(
        F.col("edit_abs") >= F.col("order_abs"))
    changes = by_edit.groupBy(*KEY, (F.col("edit_abs") - F.col("order_abs")).alias("rel")).agg(F.sum("volume").alias("v"))
    base = orders.drop("po_net_value").join(edit_runs(changes), KEY)
    base = base.join(payment_runs(smoothed_blocks(history, smoothing_window), smoothing_window), KEY, "left")
    old_enough = joins.with_whole_years(base, curr_year, curr_month, max_years)
    aged = with_ages(old_enough, F.col("_years") * 12, smoothing_window)
    aged = aged.withColumn("copies", F.col("_years") - F.floor(F.col("age") / 12).cast("int")).drop("_years")
    if sample_frac < 1:
        chance = F.lit(1.0) - F.pow(F.lit(1.0 - root), F.col("copies"))
        aged = aged.where(hash_uniform(*KEY, "age", seed=seed + 1) < chance)
    out = aged.withColumns({
        "po_net_value": F.col("_value"),
        "cumulative_portion": F.col("_before") / F.col("_value"),
        "target": F.try_divide("_now", F.col("_value") - F.col("_before")),
    })
    return out.where(F.col("cumulative_portion") < FULL_BALANCE).drop("_value", "_now", "_before")


def sane_labels(table: DataFrame, low: float = 0.0, high: float = 1.05) -> DataFrame:
    return table.where(F.col("target").between(low, high))


# --- model -----------------------------------------------------------------------

def split_by_hash(df: DataFrame, keys: list[str], test: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    u = hash_uniform(*keys, seed=seed + 7)
    return df.where(u >= test), df.where(u < test)


def _typed(df: DataFrame, features: Features) -> DataFrame:
    casts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in features.categorical}
    casts |= {c: F.col(c).cast("int") for c in features.integer}
    casts |= {c: F.col(c).cast("double") for c in features.floating}
    return df.withColumns(casts)


def category_codes(df: DataFrame, features: Features) -> DataFrame:
    """(feature, value, code, cnt): codes of each category column by falling count, then by value, any number of values."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features.categorical]))
    counts = df.select(cells.alias("c")).groupBy("c.feature", "c.value").agg(F.count(F.lit(1)).alias("cnt"))
    return ranking.ranks_in_ranges(counts, ["feature"], [F.desc("cnt"), F.col("value")], "code")


def category_levels(train: DataFrame, features: Features, prior_rows: float = 20.0) -> tuple[DataFrame, float]:
    """(feature, value, level) and the mean target: each category as the mean target of its rows, drawn to the common
    mean by ``prior_rows`` rows of it. Any number of categories will do; none are listed on the driver."""
    common = train.agg(F.coalesce(F.avg("target"), F.lit(0.0)).alias("m")).first()["m"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features.categorical]))
    sums = train.select(cells.alias("c"), "target").groupBy("c.feature", "c.value").agg(F.sum("target").alias("s"), F.count(F.lit(1)).alias("n"))
    level = (F.col("s") + prior_rows * common) / (F.col("n") + prior_rows)
    return cut_lineage(sums.select("feature", "value", level.alias("level"))), common


@dataclass
class Forest:
    """Trees over category levels and numbers, added to a base value at a learning rate.

    The trees are those of the target's distance to ``base``; ``transform`` adds ``prediction``, the base plus ``rate``
    times their mean, to typed rows.
    """

    trees: PipelineModel
    levels: DataFrame
    common: float
    categorical: list[str]
    base: float = 0.0
    rate: float = 1.0

    def encode(self, df: DataFrame) -> DataFrame:
        """Adds the level of each category; one never seen has the common mean."""
        for c in self.categorical:
            own = self.levels.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("level").alias(f"{c}_level"))
            df = df.join(own, c, "left").fillna(self.common, [f"{c}_level"])
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return self.add_trees(self.encode(df))

    def add_trees(self, encoded: DataFrame) -> DataFrame:
        """Prediction on rows that ``encode`` has seen."""
        found = self.trees.transform(encoded)
        return found.withColumn("prediction", F.lit(self.base) + F.lit(self.rate) * F.col("prediction"))


def tree_columns(features: Features) -> list[str]:
    return [f"{c}_level" for c in features.categorical] + features.integer + features.floating


def assembler(features: Features) -> VectorAssembler:
    return VectorAssembler(inputCols=tree_columns(features), outputCol="features")


def fit_forest(train: DataFrame, features: Features, trees: int = 1000, depth: int = 2, rate: float = 0.5, seed: int = 0) -> Forest:
    """One round of boosting whose step is a whole forest: base value, then the forest of what it leaves, times ``rate``.

    Each tree sees four fifths of the rows and each split four fifths of the features.
    """
    typed = _typed(train, features)
    levels, common = category_levels(typed, features)
    made = Forest(None, levels, common, features.categorical, base=common, rate=rate)
    left = made.encode(typed).withColumn("_left", F.col("target") - F.lit(made.base))
    made.trees = PipelineModel([assembler(features), fit_trees(left, tree_columns(features), "_left", trees, depth, seed)])
    return made


def regression_scores(predictions: DataFrame, label: str = "target") -> dict[str, float]:
    return {
        name: RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric).evaluate(predictions)
        for name, metric in (("rmse", "rmse"), ("mae", "mae"), ("r-squared", "r2"))
    }


def train(table: DataFrame, features: Features, seed: int = 0, **settings) -> tuple[Forest, dict[str, float]]:
    """Fit on nine tenths of the sane rows, score on the rest."""
    rows = sane_labels(table)
    fit_rows, test_rows = split_by_hash(rows, KEY + ["age"], seed=seed)
    model = fit_forest(fit_rows, features, seed=seed, **settings)
    found = cut_lineage(model.transform(_typed(test_rows, features)).select("target", "prediction"))
    return model, regression_scores(found)


def save_model(model: Forest, path: str) -> None:
    packing, trees = model.trees.stages
    packing.write().overwrite().save(f"{path}/packing")
    save_trees(model.levels.sparkSession, trees, f"{path}/trees")
    facts = {"common": F.lit(model.common), "categorical": F.array(*map(F.lit, model.categorical)), "base": F.lit(model.base), "rate": F.lit(model.rate)}
    model.levels.withColumns(facts).write.mode("overwrite").parquet(f"{path}/levels")


def load_model(spark: SparkSession, path: str) -> Forest:
    levels = spark.read.parquet(f"{path}/levels")
    first = levels.first()
    trees = PipelineModel([VectorAssembler.load(f"{path}/packing"), load_trees(spark, f"{path}/trees")])
    return Forest(trees, levels.select("feature", "value", "level"), first["common"], list(first["categorical"]), first["base"], first["rate"])


# --- inference ---------------------------------------------------------------------

def inference_rows(orders: DataFrame, history: DataFrame, curr_year: int, curr_month: int, forecast_to: int) -> DataFrame:
    """Recent orders with balance left, their age now and the portion invoiced so far."""
    recent = orders.where(
        (F.col("order_year") >= curr_year - 7) & (F.col("fund_year").cast("int") <= curr_year + forecast_to))
    aged = recent.withColumn("age", (F.lit(curr_year) - F.col("order_year")) * 12 + (F.lit(curr_month) - F.col("order_month")))
    paid = history.join(aged.select(*KEY, "age"), KEY).where(F.col("rel_month") < F.col("age"))
    before = paid.groupBy(*KEY).agg(F.sum("volume").alias("_paid"))
    out = aged.join(before, KEY, "left").withColumn(
        "cumulative_portion", F.coalesce("_paid", F.lit(0.0)) / F.col("po_net_value")).drop("_paid")
    return out.where((F.col("cumulative_portion") < FULL_BALANCE) & (F.col("age") <= MAX_AGE))


def roll_forward(model: Forest, rows: DataFrame, steps: int, features: Features, damped: bool = True) -> DataFrame:
    """Adds ``shares``: for each month ahead the part of the order value expected.

    All steps of an order are one call on its row, without a shuffle. An order not
    yet placed (negative age) waits at 0. ``damped`` takes the balance into the
    carried portion a second time, as the published forecasts do; ``False`` adds
    the expected share itself.
    """
    state = model.encode(_typed(rows, features))
    packing, trees = model.trees.stages
    columns, scorer, base, rate = packing.getInputCols(), trees.scorer(), model.base, model.rate

    @F.arrow_udf("array<double>")
    def shares(age: pa.Array, portion: pa.Array, *values: pa.Array) -> pa.Array:
        age, portion = numbers(age), numbers(portion)
        found = dict(zip(columns, map(numbers, values)))
        made = np.zeros((len(age), steps))
        for h in range(steps):
            found |= {c: v for c, v in (("age", age), ("cumulative_portion", portion)) if c in found}
            balance = np.maximum(1.0 - portion, 0.0)
            made[:, h] = np.where(age >= 0, (base + rate * scorer.predict(list(found.values()))) * balance, 0.0)
            portion = portion + (balance * made[:, h] if damped else made[:, h])
            age = age + 1
        return pa.ListArray.from_arrays(np.arange(len(age) + 1, dtype=np.int32) * steps, made.ravel())

    kept = [c for c in rows.columns if c not in ("age", "cumulative_portion")]
    return state.select(*kept, shares("age", "cumulative_portion", *columns).alias("shares"))


def forecast_orders(rolled: DataFrame, past: DataFrame, curr_month: int, forecast_to: int) -> DataFrame:
    """Amount per (order, month ahead) of the reported year.

    For a later year only its twelve months count; for the current one the sums
    already invoiced join as month 0, also of orders no longer forecast.
    """
    monthly = rolled.select(*KEY, "fingroup", "po_net_value", F.posexplode("shares").alias("_p", "_share"))
    steps = 12 - curr_month + 12 * forecast_to
    rows = monthly.select(
        *KEY, "fingroup", (F.col("_p") + 1).alias("step"), (F.col("_share") * F.col("po_net_value")).alias("amount"))
    if forecast_to > 0:
        return rows.where(F.col("step") > steps - 12)
    done = past.select(*KEY, "fingroup", F.lit(0).alias("step"), F.col("past_sum").alias("amount"))
    return rows.unionByName(done)


def order_totals(forecast: DataFrame) -> DataFrame:
    """Fine output: one row per order."""
    return forecast.groupBy(*KEY).agg(F.max("fingroup").alias("fingroup"), F.sum("amount").alias("amount"))


def group_totals(forecast: DataFrame, monthly: bool = False) -> DataFrame:
    """Output by financial group, whole or per month ahead."""
    keys = ["fingroup", "step"] if monthly else ["fingroup"]
    return forecast.groupBy(*keys).agg(F.sum("amount").alias("amount"))


def grand_total(forecast: DataFrame) -> DataFrame:
    return forecast.agg(F.sum("amount").alias("amount"))
