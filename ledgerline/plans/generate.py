"""Synthetic future orders: log-normal amounts, attributes drawn given the amount class.

Every random number is a hash of (target, draw number, feature), so the result
does not depend on partitioning and a longer run repeats the shorter one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .. import KEY
from ..functions.scalars import equal_width_bin, hash_normal, hash_uniform
from ..operators import ranking
from ..operators.joins import first_per_key
from ..session import cut_lineage
from .po import ATTRIBUTES

CLASSES = 100
CHUNK = 4096
TARGET = ["year", "month", "fund_year"]
MISSING = "\x00"  # stands for a null attribute, which is a value like any other


def log_moments(orders: DataFrame, value: str = "po_net_value") -> DataFrame:
    """Mean and sample variance of the log of positive values, and its range.

    The logs are summed as whole billionths, so the result does not depend on how the rows are dealt out.
    """
    x = F.ln(value)
    unit = F.round(x * 1e9).cast("decimal(19,0)")
    sums = orders.where(F.col(value) > 0).select(x.alias("x"), unit.alias("u")).agg(
        F.count("u").cast("double").alias("n"), F.sum("u").alias("s"), F.sum((F.col("u") * F.col("u")).cast("decimal(38,0)")).alias("q"),
        F.min("x").alias("low"), F.max("x").alias("high"))
    mean = F.try_divide(F.col("s").cast("double"), F.col("n"))
    spread = F.try_divide(F.col("q").cast("double") - mean * F.col("s").cast("double"), F.col("n") - 1)
    mu = F.least(F.greatest(mean / 1e9, F.col("low")), F.col("high"))
    return sums.select(mu.alias("mu"), (spread / 1e18).alias("sigma_squared"), "low", "high")


def with_value_class(orders: DataFrame, value: str = "po_net_value", bins: int = CLASSES, keys: list[str] = KEY) -> DataFrame:
    """First row per key, positive values only, with the bin of the log value."""
    one = first_per_key(orders.where(F.col(value) > 0), keys, [value])
    x = F.ln(value)
    low, high = one.agg(F.min(x)).scalar(), one.agg(F.max(x)).scalar()
    return one.withColumn("value_class", equal_width_bin(x, low, high, bins))


def _attribute_pairs(attributes: list[str]) -> Column:
    value = lambda a: F.coalesce(F.col(a).cast("string"), F.lit(MISSING))
    return F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), value(a).alias("value")) for a in attributes]))


def class_frequencies(classed: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Add-one smoothed share of every attribute value within every value class.

    Attributes become rows first, so one aggregation counts them all. The full
    grid (class x value of the attribute) comes from an equality join on the
    attribute; its size is bounded by the distinct values, not by the orders.
    """
    rows = classed.select("value_class", _attribute_pairs(attributes).alias("_p")).select("value_class", "_p.*")
    # at most classes x distinct values rows; written once for the four reads below
    counted = cut_lineage(rows.groupBy("value_class", "attribute", "value").agg(F.count(F.lit(1)).alias("n")))
    per_class = counted.groupBy("value_class", "attribute").agg(F.sum("n").alias("n_class"))
    domain = counted.select("attribute", "value").distinct()
    sizes = domain.groupBy("attribute").agg(F.count(F.lit(1)).alias("k"))
    grid = per_class.join(domain, "attribute").join(sizes, "attribute")
    full = grid.join(counted, ["value_class", "attribute", "value"], "left")
    return full.select(
        "value_class", "attribute", "value",
        ((F.coalesce("n", F.lit(0)) + 1.0) / (F.col("n_class") + F.col("k"))).alias("probability"))


@dataclass(frozen=True)
class ClassModel:
    """Add-one smoothed class model without a row for what was never seen.

    ``counts`` has a row for each value seen in a class; every other value of the attribute has the count 0 there, and
    so the same share. ``classes`` has the orders of each class, ``sizes`` the distinct values of each attribute.
    """

    counts: DataFrame  # value_class, attribute, value, n
    classes: DataFrame  # value_class, rows
    sizes: dict[str, int]


def class_model(classed: DataFrame, attributes: list[str] = ATTRIBUTES) -> ClassModel:
    rows = classed.select("value_class", _attribute_pairs(attributes).alias("_p")).select("value_class", "_p.*")
    counts = cut_lineage(rows.groupBy("value_class", "attribute", "value").agg(F.count(F.lit(1)).alias("n")))
    classes = counts.where(F.col("attribute") == attributes[0]).groupBy("value_class").agg(F.sum("n").alias("rows"))
    sizes = counts.select("attribute", "value").distinct().groupBy("attribute").agg(F.count(F.lit(1)).alias("k"))
    found = {r["attribute"]: r["k"] for r in sizes.collect()}  # one row per attribute
    return ClassModel(counts, classes, {a: found.get(a, 0) for a in attributes})


def class_of_features(model: ClassModel, rows: DataFrame) -> DataFrame:
    """Adds the most likely value class given the attributes (largest posterior, lower class on a tie).

    Each class starts from its share and from the score of values never seen in it; only values that were seen add to
    it, so a combination meets the classes of its values and one more, the best of those that saw none of them. Only
    distinct combinations are scored, nulls as values of their own; they join back by a plain join, whose skewed
    partitions are split.
    """
    attributes = list(model.sizes)
    start = F.ln("rows") - reduce(lambda x, y: x + y, [F.ln(F.col("rows") + k) for k in model.sizes.values()])
    base = model.classes.select("value_class", start.alias("base"))
    best = lambda score: F.struct(score.alias("lp"), (-F.col("value_class")).alias("c"))
    fallback = base.agg(F.max(best(F.col("base"))).alias("b")).first()["b"]  # at most ``CLASSES`` rows
    combos = rows.select(*attributes).distinct()
    long = combos.select(*attributes, _attribute_pairs(attributes).alias("_p")).select(*attributes, "_p.*")
    seen = long.join(model.counts, ["attribute", "value"]).groupBy(*attributes, "value_class").agg(F.sum(F.ln(F.col("n") + 1)).alias("gain"))
    scored = seen.join(base, "value_class").groupBy(*attributes).agg(F.max(best(F.col("base") + F.col("gain"))).alias("_b"))
    same = lambda left, right: reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[f"_{a}"]) for a in attributes])
    named = scored.select(*[F.col(a).alias(f"_{a}") for a in attributes], "_b")
    most = F.greatest(F.col("_b"), F.struct(F.lit(fallback["lp"]).alias("lp"), F.lit(fallback["c"]).alias("c")))
    return rows.join(named, same(rows, named), "left").withColumn("likely_class", -most["c"]).drop("_b", *[f"_{a}" for a in attributes])


def _by_bucket(intervals: DataFrame, buckets: str, whole: str) -> DataFrame:
    """Each interval ``low`` to ``high`` of 0 .. ``whole`` - 1 under every one of its class' ``buckets`` it reaches."""
    at = lambda x: F.floor(F.try_divide(F.col(x) * F.col(buckets), F.col(whole)))
    return intervals.where(F.col("low") <= F.col("high")).withColumn("bucket", F.explode(F.sequence(at("low"), at("high"))))


def draw_attributes(drawn: DataFrame, model: ClassModel, ids: list[str], seed: int) -> DataFrame:
    """One value per attribute for each drawn amount, by its class' shares.

    A class has n + 1 lots for a value seen n times and one for every other value of the attribute. A drawn lot finds
    its value by an interval join: the values seen, and the gaps between them for the others, lie under as many buckets
    as there are intervals, so a draw meets about one of them, however many values there are.
    """
    attributes = list(model.sizes)
    domain = model.counts.select("attribute", "value").distinct()
    ranked = cut_lineage(ranking.ranks_in_ranges(domain, ["attribute"], [F.col("value")]))
    sizes = F.create_map(*[x for a, k in model.sizes.items() for x in (F.lit(a), F.lit(k).cast("long"))])
    per = ["value_class", "attribute"]
    placed = model.counts.join(ranked, ["attribute", "value"])
    w = Window.partitionBy(*per).orderBy("rank")
    lots = F.col("n") + 1
    seen = cut_lineage(placed.select(
        *per, "rank", (F.row_number().over(w) - 1).cast("long").alias("i"), F.lag("rank").over(w).alias("before"),
        (F.sum(lots).over(w) - lots).alias("low"), (F.sum(lots).over(w) - 1).alias("high")))
    facts = seen.groupBy(*per).agg(F.count(F.lit(1)).alias("seen"), (F.max("high") + 1).alias("own"), F.max("rank").alias("last"))
    facts = cut_lineage(facts.withColumn("others", F.try_element_at(sizes, F.col("attribute")) - F.col("seen")))
    hits = _by_bucket(seen.join(facts, per), "seen", "own").select(*per, F.lit(True).alias("own_lot"), "bucket", "low", "high", F.col("rank").alias("base"))
    # a gap before the i-th value seen, and one behind the last: numbers of the other values in it
    gap = seen.join(facts, per).select(*per, "seen", "others", "i", (F.coalesce("before", F.lit(-1)) + 1 - F.col("i")).alias("low"), (F.col("rank") - F.col("i") - 1).alias("high"))
    behind = facts.select(*per, "seen", "others", F.col("seen").alias("i"), (F.col("last") + 1 - F.col("seen")).alias("low"), (F.col("others") - 1).alias("high"))
    gaps = _by_bucket(gap.unionByName(behind).withColumn("parts", F.col("seen") + 1), "parts", "others").select(
        *per, F.lit(False).alias("own_lot"), "bucket", "low", "high", F.col("i").alias("base"))
    found = cut_lineage(hits.unionByName(gaps))

    out = drawn
    for i, a in enumerate(attributes):  # one after the other, so a draw is one row all the way
        mine = lambda df: df.where(F.col("attribute") == a).drop("attribute")  # noqa: B023, E731
        sized = out.join(F.broadcast(mine(facts)), "value_class")  # a row per class
        sized = sized.withColumn("lot", F.floor(hash_uniform(*ids, seed=seed + 100 + i) * (F.col("own") + F.col("others"))))
        sized = sized.withColumn("own_lot", F.col("lot") < F.col("own")).withColumn("lot", F.col("lot") - F.when(F.col("own_lot"), F.lit(0)).otherwise(F.col("own")))
        sized = sized.withColumn("bucket", F.when(F.col("own_lot"), F.floor(F.col("lot") * F.col("seen") / F.col("own"))).otherwise(
            F.floor(F.try_divide(F.col("lot") * (F.col("seen") + 1), F.col("others"))))).drop("seen", "own", "others", "last")
        at = mine(found).withColumnsRenamed({"value_class": "_class", "own_lot": "_own", "bucket": "_bucket"})
        same = (F.col("value_class") == F.col("_class")) & (F.col("own_lot") == F.col("_own")) & (F.col("bucket") == F.col("_bucket"))
        met = sized.join(at, same & F.col("lot").between(F.col("low"), F.col("high")), "left")
        met = met.withColumn("rank", F.col("base") + F.when(F.col("own_lot"), F.lit(0)).otherwise(F.col("lot"))).select(*out.columns, "rank")
        named = mine(ranked).withColumn(a, F.nullif("value", F.lit(MISSING))).drop("value")
        out = met.join(named, "rank", "left").drop("rank")
    return out.select(*ids, *[c for c in drawn.columns if c not in ids], *attributes)


def draw_amounts(targets: DataFrame, moments: Row, known_classes: DataFrame, stretch: float | str, seed: int) -> DataFrame:
    """Numbered amounts per target, about ``stretch`` (a number or a column) times the expected need; unseen classes are skipped.

    Draws are generated in chunks, so one large target spreads over many tasks.
    """
    variance = moments.sigma_squared or 0.0  # a single order has none
    expected = math.exp(moments.mu + variance / 2.0)
    times = F.col(stretch) if isinstance(stretch, str) else F.lit(stretch)
    chunks = (F.ceil(F.col("amount") * times / F.lit(expected * CHUNK)) + 1).cast("int")
    blocks = targets.where(F.col("amount") > 0).select(
        *TARGET, F.col("amount").alias("target_amount"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    blocks = blocks.repartition(*TARGET, "chunk")
    draws = blocks.withColumn("draw", F.explode(F.sequence(
        F.col("chunk").cast("long") * CHUNK, (F.col("chunk").cast("long") + 1) * CHUNK - 1)))
    log_amount = F.lit(moments.mu) + F.lit(math.sqrt(variance)) * hash_normal(*TARGET, "draw", seed=seed)
    sized = draws.withColumn("log_amount", log_amount).where(F.col("log_amount").between(moments.low, moments.high))
    sized = sized.withColumns({
        "value_class": equal_width_bin("log_amount", F.lit(moments.low), F.lit(moments.high), CLASSES),
        "po_net_value": F.exp("log_amount"),
    }).drop("log_amount")
    return sized.join(known_classes, "value_class", "left_semi")


def up_to_target(draws: DataFrame) -> DataFrame:
    """Draws in order until the running total reaches the target, the reaching one included.

    The running total is two-level: chunk sums first, then within each chunk, so
    no task sees more than one chunk of one target. Spark sizes the draws as the chunks
    they were exploded from, so the join is sorted lest it broadcasts them.
    """
    sums = draws.groupBy(*TARGET, "chunk").agg(F.sum("po_net_value").alias("_s"))
    before = Window.partitionBy(*TARGET).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*TARGET, "chunk", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_offset"))
    inside = Window.partitionBy(*TARGET, "chunk").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    placed = draws.join(offsets.hint("merge"), [*TARGET, "chunk"]).where(F.col("_offset") < F.col("target_amount"))
    placed = placed.withColumn("_before", F.col("_offset") + F.coalesce(F.sum("po_net_value").over(inside), F.lit(0.0)))
    return placed.where(F.col("_before") < F.col("target_amount")).drop("_offset", "_before")


def number_orders(kept: DataFrame) -> DataFrame:
    """Keys ``<n>N`` / fund year / 10 and the first of the month as the order date.

    Numbers run over targets in order, two-level like the running total.
    """
    counts = kept.groupBy(*TARGET, "chunk").agg(F.count(F.lit(1)).alias("_n"))
    # one row per chunk of orders is left here, and one per configured target below
    blocks = counts.groupBy(*TARGET).agg(F.sum("_n").alias("_t"))
    prior = Window.orderBy(*TARGET).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*TARGET, F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_start"))
    earlier = Window.partitionBy(*TARGET).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*TARGET, "chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy(*TARGET, "chunk").orderBy("draw")
    out = kept.withColumn("_rn", F.row_number().over(inside) - 1).join(offsets.hint("merge"), [*TARGET, "chunk"])
    out = out.join(F.broadcast(starts), TARGET)  # a row per target
    number = F.col("_start") + F.col("_skip") + F.col("_rn")
    return out.withColumns({
        "doc_id": F.concat(number.cast("string"), F.lit("N")),
        "item": F.lit("10"),
        "order_date": F.concat(F.lit("01."), F.lpad("month", 2, "0"), F.lit("."), F.col("year")),
    }).drop("_start", "_skip", "_rn")


def synthetic_orders(orders: DataFrame, targets: DataFrame, seed: int = 0, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Orders whose values reach each target amount; empty targets give an empty table.

    The first stretch generously covers the need. Only targets that are still short have theirs doubled, as often as
    it takes; a round in which none of them gains anything is an error. Without orders there is nothing to draw from.
    """
    # counts of the values seen, and four numbers: made once, read by every step below
    model = class_model(with_value_class(orders), attributes)
    known = model.classes.select("value_class")
    moments = log_moments(orders).first()
    if moments.mu is None:
        raise ValueError("no order with a positive value to learn from")
    pending = targets.where(F.col("amount") > 0).select(*TARGET, "amount").withColumns({"_stretch": F.lit(1.5), "_had": F.lit(-1.0)})
    reached = None
    while True:
        got = draw_amounts(pending, moments, known, "_stretch", seed).groupBy(*TARGET).agg(F.sum("po_net_value").alias("_got"))
        tried = cut_lineage(pending.join(got, TARGET, "left").withColumn("_got", F.coalesce("_got", F.lit(0.0))))
        done = tried.where(F.col("_got") >= F.col("amount")).select(*TARGET, "amount", "_stretch")
        reached = done if reached is None else reached.unionByName(done)
        short = tried.where(F.col("_got") < F.col("amount"))
        state = short.agg(F.count(F.lit(1)).alias("n"), F.max((F.col("_got") > F.col("_had")).cast("int")).alias("gains")).first()
        if not state["n"]:
            break
        if not state["gains"]:
            raise RuntimeError("no draw falls into a known amount class")
        pending = short.select(*TARGET, "amount", (F.col("_stretch") * 2).alias("_stretch"), F.col("_got").alias("_had"))
    kept = number_orders(up_to_target(draw_amounts(reached, moments, known, "_stretch", seed)))
    out = draw_attributes(cut_lineage(kept), model, [*TARGET, "draw"], seed)
    return out.select(*KEY, *attributes, "po_net_value", "order_date")


