"""Mixing sources to target weights with a Pfair schedule, in DataFrame functions only.

Time is counted in slots, one block each. A source of weight w out of a total of q must have its k-th block between
the release floor((k - 1) q / w) and the deadline ceil(k q / w). Earliest-deadline-first over released blocks meets
all deadlines, so at every moment each source is less than one block away from its exact share. With whole weights
the schedule repeats every q slots, so only one period is worked out and every block finds its slot by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 32


def weight_column(weights: dict[str, int], default: int, source: str = "source") -> Column:
    found = F.lit(default)
    for name, weight in weights.items():
        found = F.when(F.col(source) == name, F.lit(weight)).otherwise(found)
    return found.cast("long")


def schedule(weighted: DataFrame) -> DataFrame:
    """One period from (source, weight): source, weight, period, k (from 0) and slot (from 0).

    One row per slot of a period, so its size is the total weight, whatever the number of documents. Sources may be
    null; weights must be whole and positive.
    """
    packed = weighted.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("w"), F.sum("weight").alias("q"))
    start = F.struct(F.transform("w", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picks"))

    def step(state: Column, t: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            done = F.element_at(state["done"], i + 1)
            release = F.floor(done * F.col("q") / x["weight"])
            deadline = F.ceil((done + 1) * F.col("q") / x["weight"])
            return F.when(release <= t, F.struct(deadline.alias("deadline"), i.alias("i")))

        def take(best: Column) -> Column:
            return F.struct(
                F.transform(state["done"], lambda d, i: d + (i == best["i"]).cast("long")).alias("done"),
                F.array_append(state["picks"], best["i"].cast("int")).alias("picks"))

        return F.element_at(F.transform(F.array(F.array_min(F.transform("w", window))), take), 1)

    picks = packed.where("q > 0").select("w", "q", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), start, step)["picks"].alias("picks"))
    slots = picks.select("q", F.posexplode(F.transform("picks", lambda i: F.element_at(F.col("w"), i + 1))).alias("slot", "x"))
    return slots.select(
        F.col("x.source").alias("source"), F.col("x.weight").alias("weight"), F.col("q").alias("period"), F.col("slot").cast("long").alias("slot"),
        (F.row_number().over(Window.partitionBy("x.source").orderBy("slot")) - 1).cast("long").alias("k"))


def _no_null(column: str) -> Column:
    """The value after a sign that it is there, so that null is a value of its own and joins as any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def rank_in(rows: DataFrame, key: str, order: str, digits: int = 3) -> DataFrame:
    """Add ``rank`` (from 0) of a row within ``key`` (no nulls) by the hex string in column ``order``, then by doc_id.

    A key is cut into 16**digits ranges of the string, ranked apart and shifted by the rows before them, so a source
    with a third of all rows is not sorted in one task. Join and window share one shuffle.
    """
    cut = rows.withColumn("_range", F.substring(order, 1, digits))
    before = cut.groupBy(key, "_range").agg(F.count("*").alias("n")).withColumn(
        "_before", F.sum("n").over(Window.partitionBy(key).orderBy("_range")) - F.col("n")).select(key, "_range", "_before")
    joined = cut.join(before, [key, "_range"])
    ranked = joined.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order, "doc_id")))
    return ranked.withColumn("rank", F.col("_before") + F.col("_rank") - 1).drop("_range", "_rank", "_before")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1, block_rows: int = BLOCK_ROWS, seed: str = "mix") -> DataFrame:
    """Add block, row_in_block, mix_slot, release_slot, deadline_slot and in_mix to every row of ``docs`` (doc_id, source, ...).

    Rows of a source are put in a seeded random order and cut into blocks. Sorting by (mix_slot, row_in_block) gives
    the mixture. No row is dropped: ``in_mix`` is true before the first slot for which some source has run out of
    blocks, up to which the shares hold; later slots go on with the sources that are left. A null source is a source
    of its own, a null id is ordered as an empty one, repeated rows stay, and columns of these names are replaced.
    """
    added = {"block", "row_in_block", "mix_slot", "release_slot", "deadline_slot", "in_mix", "rank", "k", "weight", "period", "slot", "horizon"}
    rows = docs.drop(*(added & set(docs.columns))).withColumn("_s", _no_null("source")).withColumn(
        "_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sizes = docs.groupBy("source").agg(F.count("*").alias("rows")).withColumn("weight", weight_column(weights or {}, default_weight))
    # one row per slot of a period: its size is the total weight, not the number of documents
    plan = schedule(sizes.select("source", "weight")).withColumn("_s", _no_null("source")).drop("source")
    blocks = F.ceil(F.col("rows") / block_rows)
    # the first slot that would need a block which a source no longer has
    ends = plan.join(sizes.select(_no_null("source").alias("_s"), blocks.alias("blocks")), "_s").where(F.col("k") == F.col("blocks") % F.col("weight"))
    horizon = ends.agg(F.min(F.floor(F.col("blocks") / F.col("weight")) * F.col("period") + F.col("slot")).alias("horizon"))
    ranked = rank_in(rows, "_s", "_order").withColumn("block", F.floor(F.col("rank") / block_rows)).withColumn("row_in_block", F.col("rank") % block_rows)
    totals = plan.groupBy("_s").agg(F.max("weight").alias("weight"), F.max("period").alias("period"))
    ranked = ranked.join(F.broadcast(totals), "_s").withColumn("k", F.col("block") % F.col("weight"))
    placed = ranked.join(F.broadcast(plan.select("_s", "k", "slot")), ["_s", "k"])
    placed = placed.withColumn("mix_slot", F.floor(F.col("block") / F.col("weight")) * F.col("period") + F.col("slot"))
    # one row with one number
    placed = placed.crossJoin(F.broadcast(horizon)).withColumn("in_mix", F.col("mix_slot") < F.col("horizon"))
    placed = placed.withColumn("release_slot", F.floor(F.col("block") * F.col("period") / F.col("weight"))).withColumn(
        "deadline_slot", F.ceil((F.col("block") + 1) * F.col("period") / F.col("weight")))
    return placed.drop("_order", "_s", "k", "weight", "period", "slot", "horizon", "rank")


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of the mixture: by range of slots over the partitions, sorted within them."""
    return mixed.repartitionByRange("mix_slot", "row_in_block").sortWithinPartitions("mix_slot", "row_in_block")
