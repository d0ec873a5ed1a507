"""Regression forest that keeps no weight per row and tree: draws are made anew in every pass.

Bounds of bins come from the counts of all values. Rows alike in all bins and in target become one with their number,
m: the sum of m Poisson draws is one draw with m times the mean, so nothing is lost. A level of all trees is one pass:
each task adds up, per open node and bin of each feature, the drawn rows and their targets as products of two matrices,
and only these sums are shuffled. Targets are summed as whole units, and the draws of a row come from the hash of its
bins and target, so a fit does not depend on how rows are dealt out.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.base import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS = 32
BIN_BITS = 5
PACKED = 12  # bins in one long
FEW_ROWS = 10_000  # so many are counted on the driver
BLOCK = 2048  # rows of one product, which stand for at most
BLOCK_ROWS = 1 << 20  # rows; four times that fits a float, and times 2 ``UNITS`` a double
LUMP = 64  # more rows than that are drawn by a generator of their own
PASS_CELLS = 1 << 20  # sums (node, bin) of one pass over the rows
TABLE_CELLS = 1 << 21
UNITS = 2.0**30
ROOT = 1  # children of node i are 2 i and 2 i + 1


class Tree:
    """Nodes by number: (feature, threshold, value); a leaf has the feature -1. A value up to the threshold goes left."""

    def __init__(self, nodes: dict[int, tuple[int, float, float]]) -> None:
        self.nodes = nodes

    def predict(self, features) -> float:
        at = ROOT
        while self.nodes[at][0] >= 0:
            feature, threshold, _ = self.nodes[at]
            at = 2 * at + (0 if features[feature] <= threshold else 1)
        return self.nodes[at][2]

    def leaves(self) -> Iterator[tuple[list[tuple[int, float, bool]], float]]:
        """Each leaf's path as (feature, threshold, left), and its value."""
        todo = [(ROOT, [])]
        while todo:
            at, path = todo.pop()
            feature, threshold, value = self.nodes[at]
            if feature < 0:
                yield path, value
            else:
                todo += [(2 * at, [*path, (feature, threshold, True)]), (2 * at + 1, [*path, (feature, threshold, False)])]


class Scorer:
    """Mean of the trees for rows of numbers.

    A leaf is a box over the few features of its path. Boxes over the same features add up to one table over their
    bins, so a row looks up one cell per set of features; trees too deep for tables are walked one by one.
    """

    def __init__(self, trees: list[Tree], width: int) -> None:
        self.width, self.tables, self.trees = width, {}, None
        found: list[set[float]] = [set() for _ in range(width)]
        boxes = []
        for tree in trees:
            for path, value in tree.leaves():
                for f, t, _ in path:
                    found[f].add(t)
                boxes.append((path, value / len(trees)))
        self.bounds = [np.array(sorted(x)) for x in found]
        sets = {tuple(sorted({f for f, _, _ in path})) for path, _ in boxes}
        if sum(math.prod(len(self.bounds[f]) + 1 for f in s) for s in sets) > TABLE_CELLS:
            self.trees = trees
            return
        self.tables = {s: np.zeros([len(self.bounds[f]) + 1 for f in s]) for s in sets}
        for path, value in boxes:
            key = tuple(sorted({f for f, _, _ in path}))
            limits = {f: [0, len(self.bounds[f]) + 1] for f in key}
            for f, t, left in path:
                at = int(np.searchsorted(self.bounds[f], t)) + 1
                limits[f] = [limits[f][0], min(limits[f][1], at)] if left else [max(limits[f][0], at), limits[f][1]]
            self.tables[key][tuple(slice(*limits[f]) for f in key)] += value

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        """One number per row of ``columns``, one array per feature; a null or NaN is an error."""
        if any(np.isnan(c).any() for c in columns):
            raise ValueError("a feature is null or NaN")
        n = len(columns[0])
        if self.trees is not None:
            return self._walk(columns)
        bins = [np.searchsorted(b, c, side="left") if len(b) else None for b, c in zip(self.bounds, columns)]
        out = np.zeros(n)
        for key, table in self.tables.items():
            out += table[tuple(bins[f] for f in key)]
        return out

    def _walk(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(columns[0]))
        for tree in self.trees:
            todo = [(ROOT, np.arange(len(out)))]
            while todo:
                at, rows = todo.pop()
                feature, threshold, value = tree.nodes[at]
                if feature < 0:
                    out[rows] += value
                elif len(rows):
                    left = columns[feature][rows] <= threshold
                    todo += [(2 * at, rows[left]), (2 * at + 1, rows[~left])]
        return out / len(self.trees)


def numbers(array: pa.Array) -> np.ndarray:
    """Doubles of an Arrow column; null is NaN."""
    return array.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


class ForestModel(Model):
    """Adds ``prediction``, the mean of the trees, to rows with a vector ``features``."""

    def __init__(self, trees: list[Tree], width: int) -> None:
        super().__init__()
        self.trees, self.width = trees, width

    def scorer(self) -> Scorer:
        return Scorer(self.trees, self.width)

    def _transform(self, df: DataFrame) -> DataFrame:
        scorer, width = self.scorer(), self.width

        @F.arrow_udf("double")
        def mean_of_trees(rows: pa.Array) -> pa.Array:
            values = numbers(rows.flatten()).reshape(-1, width)
            return pa.array(scorer.predict([np.ascontiguousarray(values[:, f]) for f in range(width)]) if len(values) else np.zeros(0))

        return df.withColumn("prediction", mean_of_trees(vector_to_array("features")))

    def rows(self) -> list[tuple[int, int, int, float, float]]:
        return [(t, at, *node) for t, tree in enumerate(self.trees) for at, node in tree.nodes.items()]


ROWS = "tree int, node long, feature int, threshold double, value double"


def save_trees(spark, model: ForestModel, path: str) -> None:
    rows = spark.createDataFrame(model.rows(), ROWS)
    rows.withColumn("width", F.lit(model.width)).coalesce(1).write.mode("overwrite").parquet(path)


def load_trees(spark, path: str) -> ForestModel:
    found = spark.read.parquet(path).orderBy("tree", "node").collect()  # as many as the trees have nodes
    trees = [Tree({r["node"]: (r["feature"], r["threshold"], r["value"]) for r in rows}) for _, rows in itertools.groupby(found, lambda r: r["tree"])]
    return ForestModel(trees, found[0]["width"])


def split_bounds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between all distinct values or, if there are too many, at about even steps of the rows."""
    distinct, counts = np.unique(values, return_counts=True)
    return _bounds_of(distinct, np.cumsum(counts), len(distinct), len(values), bins)


def _bounds_of(values: np.ndarray, sums: np.ndarray, distinct: int, n: int, bins: int) -> np.ndarray:
    """Thresholds from ordered values with the rows up to each; of ``distinct`` values those away from all steps may be missing."""
    middles = (values[1:] + values[:-1]) / 2
    if distinct - 1 < bins:
        return middles
    step = n / bins
    out, target = [], step
    for i in range(1, len(values)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            out.append(middles[i - 1])
            target += step
    return np.array(out)


def all_bounds(rows: DataFrame, names: list[str], n: int, bins: int = BINS) -> list[np.ndarray]:
    """``split_bounds`` of each column over all ``n`` rows, whatever their number.

    Values are counted, dealt into ordered ranges and summed there. The driver gets only those near a step: the value in
    which it falls, the one before and ``bins`` behind, and as many at the start of a range.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, column in enumerate(batch.columns):
                values, counts = np.unique(column.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, dtype=np.int32)), pa.array(values), pa.array(counts)], names=["f", "v", "c"])

    counted = rows.select(*names).mapInArrow(count, "f int, v double, c bigint").groupBy("f", "v").agg(F.sum("c").alias("c"))
    dealt = cut_lineage(counted.repartitionByRange("f", "v").withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy("f", "_range").agg(F.sum("c").alias("_rows"), F.count(F.lit(1)).alias("_values"))  # one row per range
    before = Window.partitionBy("f").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    w = Window.partitionBy("f", "_range").orderBy("v")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(F.broadcast(starts), ["f", "_range"]).withColumns({"i": F.row_number().over(w), "total": F.col("_start") + F.sum("c").over(so_far)})
    step = lambda c: F.floor(c * F.lit(float(bins)) / F.lit(float(n)))
    placed = placed.withColumn("met", step(F.col("total")) > step(F.col("total") - F.col("c")))
    last = F.max(F.when(F.col("met"), F.col("i"))).over(so_far)
    near = placed.withColumns({"last": last, "next": F.lead("met").over(w)}).where(
        (F.col("i") <= bins) | (F.col("i") == F.col("_values")) | F.col("next") | (F.col("i") - F.col("last") <= bins))
    found = near.select("f", "v", "total").toArrow()  # some dozens per range and step
    distinct = {r["f"]: r["n"] for r in parts.groupBy("f").agg(F.sum("_values").alias("n")).collect()}  # one row per feature
    out = []
    for f in range(len(names)):
        mine = found.filter(pa.compute.equal(found.column("f"), f)).sort_by("v")
        out.append(_bounds_of(mine.column("v").to_numpy(), mine.column("total").to_numpy(), distinct[f], n, bins))
    return out


@functools.lru_cache(maxsize=2 * LUMP)
def poisson_table(mean: float) -> np.ndarray:
    """Number drawn for each of 65,536 equally likely values; means up to about 100."""
    share, total, out = math.exp(-mean), 0.0, np.zeros(1 << 16, dtype=np.uint8)
    for k in range(1, 60 + int(2 * mean)):
        total += share
        out[min(1 << 16, round(total * (1 << 16))):] = k
        share *= mean / k
    return out


def weights(hashes: np.ndarray, times: np.ndarray, trees: int, share: float) -> np.ndarray:
    """(rows, trees): how often each tree draws the ``times`` rows that each row stands for, ``share`` of them on average."""
    out = np.empty((len(hashes), trees), dtype=np.float32)
    for m in np.unique(times):
        if m <= LUMP:
            mine = np.flatnonzero(times == m)
            out[mine] = draws(hashes[mine], trees, poisson_table(share * int(m)))
    for i in np.flatnonzero(times > LUMP):
        out[i] = np.random.Generator(np.random.Philox(key=int(hashes[i]) % (1 << 64))).poisson(share * times[i], trees)
    return out


def draws(hashes: np.ndarray, trees: int, table: np.ndarray) -> np.ndarray:
    """(rows, trees): how often each tree draws each row, from mixed 64-bit numbers, four draws in each."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64)[:, None] + np.arange(1, (trees + 3) // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return table[x.view(np.uint16)[:, :trees]]


def apart(hashes: np.ndarray) -> np.ndarray:
    """Hashes of a batch with equal ones told apart by their order; rows that repeat in other batches share their draws."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    if head.all():
        return hashes
    place = np.arange(len(order))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = place - np.maximum.accumulate(np.where(head, place, 0))
    with np.errstate(over="ignore"):
        return hashes + rank * np.int64(0x632BE59BD9B4E019)


def binned(rows: DataFrame, width: int, bounds: list[np.ndarray], unit: float, seed: int) -> DataFrame:
    """Rows alike in all bins and in target as one: the bins packed into longs, the target in units, ``m`` rows and a hash."""
    keys = [f"k{i}" for i in range(math.ceil(width / PACKED))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.zeros(batch.num_rows, dtype=np.int64) for _ in keys]
            for f, b in enumerate(bounds):
                packed[f // PACKED] |= np.searchsorted(b, batch.column(f).to_numpy(), side="left") << (f % PACKED * BIN_BITS)
            target = np.rint(batch.column(width).to_numpy() * unit).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*packed, target)], names=[*keys, "u"])

    alike = rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in (*keys, "u"))).groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("m"))
    most = BLOCK_ROWS // 2
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / most))))
    m = F.least(F.lit(most), F.col("m") - F.col("part") * most).cast("bigint")
    return cut_lineage(parts.select(*keys, "u", m.alias("m"), F.xxhash64(*keys, "u", "part", F.lit(seed)).alias("h")))


def _blocks(times: np.ndarray) -> Iterator[slice]:
    """Slices of at most ``BLOCK`` rows that stand for at most ``BLOCK_ROWS``."""
    a, sums = 0, np.cumsum(times)
    while a < len(times):
        z = max(a + 1, min(a + BLOCK, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + BLOCK_ROWS, side="right"))))
        yield slice(a, z)
        a = z


def _sums(rows: DataFrame, width: int, bounds: list[np.ndarray], nodes: list[tuple[int, tuple]], trees: int, share: float, usual: int) -> DataFrame:
    """(node, cell, n, s): drawn rows and units of their targets per open node (tree, path) and bin of each feature.

    Targets are added up as their distance to ``usual``, the most frequent one, so rows that have it cost one product only.
    """
    by_path: dict[tuple, list[int]] = {}
    for i, (_, path) in enumerate(nodes):
        by_path.setdefault(path, []).append(i)
    groups = [(path, np.array(at), np.array([nodes[i][0] for i in at])) for path, at in by_path.items()]
    first = np.r_[0, np.cumsum([len(b) + 1 for b in bounds])]
    cells, longs = int(first[-1]), math.ceil(width / PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((len(nodes), cells), dtype=np.int64), np.zeros((len(nodes), cells), dtype=np.int64)
        for batch in batches:
            packed = [batch.column(i).to_numpy() for i in range(longs)]
            target, times, hashes = (batch.column(longs + i).to_numpy() for i in range(3))
            hashes = apart(hashes)
            bins = [packed[f // PACKED] >> (f % PACKED * BIN_BITS) & (1 << BIN_BITS) - 1 for f in range(width)]
            for at_once in _blocks(times):
                bin_of = [b[at_once] for b in bins]
                drawn = weights(hashes[at_once], times[at_once], trees, share)
                here = np.zeros((len(drawn), len(nodes)), dtype=np.float32)
                for path, at, who in groups:
                    held = drawn[:, who]
                    if path:
                        held = held * np.logical_and.reduce([(bin_of[f] <= k) == left for f, k, left in path])[:, None]
                    here[:, at] = held
                hot = np.zeros((len(drawn), cells), dtype=np.float32)
                for f in range(width):
                    hot[np.arange(len(drawn)), first[f] + bin_of[f]] = 1.0
                # whole numbers: counts below 2 ** 24 are exact in floats, and units below 2 ** 53 in doubles
                n += (here.T @ hot).astype(np.int64)
                apart_by = (target[at_once] - usual).astype(np.float64)
                other = np.flatnonzero(apart_by)
                if len(other):
                    s += (here[other].T.astype(np.float64) @ (hot[other] * apart_by[other, None])).astype(np.int64)
        s += n * usual
        node, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n[node, cell]), pa.array(s[node, cell])], names=["node", "cell", "n", "s"])

    found = rows.mapInArrow(run, "node int, cell int, n bigint, s bigint")
    return found.groupBy("node", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _best(n: np.ndarray, s: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[int, int, tuple, tuple] | None:
    """Feature and bin of the largest fall in variance with the sums on both sides, if there is any."""
    total_n, total_s = n[first[0]:first[1]].sum(), s[first[0]:first[1]].sum()
    found, best = None, 1e-12 * total_s**2 / max(total_n, 1)
    for f in sorted(allowed):
        left_n, left_s = np.cumsum(n[first[f]:first[f + 1]])[:-1], np.cumsum(s[first[f]:first[f + 1]])[:-1]
        ok = (left_n > 0) & (left_n < total_n)
        if not ok.any():
            continue
        right_n, right_s = total_n - left_n, total_s - left_s
        gain = np.where(ok, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - total_s**2 / total_n, -1.0)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (int(f), k, (left_n[k], left_s[k]), (right_n[k], right_s[k]))
    return found


def fit_trees(
    df: DataFrame, columns: list[str], label: str, trees: int, depth: int, seed: int = 0, row_share: float = 0.8, feature_share: float = 0.8,
) -> ForestModel:
    """Trees over the number ``columns``; each draws every row a Poisson number of times, ``row_share`` on average, and
    each split sees ``feature_share`` of the features. Null or NaN features or labels are errors, as is an empty table."""
    width = len(columns)
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    rows = cut_lineage(df.select(*values, F.col(label).cast("double").alias("y")))
    names = [f"x{i}" for i in range(width)]
    broken = F.max(F.greatest(*[(F.col(c).isNull() | F.isnan(c)).cast("int") for c in [*names, "y"]]))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), broken.alias("broken"), F.max(F.abs("y")).alias("top")).first()
    if not facts["n"]:
        raise ValueError("no rows to learn from")
    if facts["broken"]:
        raise ValueError("a feature or label is null or NaN")
    unit = UNITS / facts["top"] if facts["top"] else UNITS
    if facts["n"] <= FEW_ROWS:
        seen = rows.select(*names).toArrow()
        bounds = [split_bounds(seen.column(c).to_numpy()) for c in names]
    else:
        bounds = all_bounds(rows, names, facts["n"])
    alike = binned(rows, width, bounds, unit, seed)
    usual = alike.groupBy("u").agg(F.sum("m").alias("rows")).orderBy(F.desc("rows"), "u").first()["u"]
    first = np.r_[0, np.cumsum([len(b) + 1 for b in bounds])]
    cells, picked = int(first[-1]), max(1, math.ceil(feature_share * width))

    made: list[dict] = [{} for _ in range(trees)]
    nodes = [(t, ROOT, ()) for t in range(trees)]
    for _ in range(depth):
        following = []
        per_pass = max(1, PASS_CELLS // cells)
        for a in range(0, len(nodes), per_pass):
            part = nodes[a:a + per_pass]
            found = _sums(alike, width, bounds, [(t, path) for t, _, path in part], trees, row_share, usual).toArrow()  # at most PASS_CELLS rows
            n, s = np.zeros((len(part), cells)), np.zeros((len(part), cells))
            where = found.column("node").to_numpy(), found.column("cell").to_numpy()
            n[where], s[where] = found.column("n").to_numpy(), found.column("s").to_numpy()
            for i, (t, at, path) in enumerate(part):
                allowed = np.random.default_rng([seed, t, at]).permutation(width)[:picked]
                total_n, total_s = n[i, :first[1]].sum(), s[i, :first[1]].sum()
                value = float(total_s / max(total_n, 1) / unit)
                best = _best(n[i], s[i], first, allowed)
                if best is None:
                    made[t][at] = (-1, 0.0, value)
                    continue
                f, k, left, right = best
                made[t][at] = (f, float(bounds[f][k]), value)
                for side, (side_n, side_s) in enumerate((left, right)):
                    child = 2 * at + side
                    made[t][child] = (-1, 0.0, float(side_s / side_n / unit))
                    following.append((t, child, (*path, (f, k, side == 0))))
        nodes = following
    return ForestModel([Tree(m or {ROOT: (-1, 0.0, 0.0)}) for m in made], width)
