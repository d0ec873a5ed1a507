"""Embedding near-duplicates by iterative quantisation.

Rotations learnt on a bounded sample turn vectors into balanced binary codes. The codes are cut into parts, each the
index of one Hamming table; vectors that agree in any part meet there and are reranked by the cosine of the original
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

THRESHOLD = 0.98
ROTATIONS = 3
PART_BITS = 16
SAMPLE = 5_000
TILE = 512


def fit_rotation(sample: np.ndarray, centre: bool = True, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation: principal axes, then a rotation fitted to their signs.

    ``sample`` is n x d; the projection is d x d. With fewer rows than needed for the axes the result is still a
    rotation, only less balanced. Without ``centre`` the planes go through the origin, so vectors at a small angle keep
    most bits even if nearly all vectors form one group, which a centred code would cut in the middle.
    """
    dims = sample.shape[1]
    mean = sample.mean(axis=0) if centre and len(sample) else np.zeros(dims)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(dims))
    axes = axes[:, ::-1]
    spread = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    for _ in range(rounds if len(sample) else 0):
        signs = np.where(spread @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(spread.T @ signs)
        rotation = u @ vt
    return mean, axes @ rotation


def codes(units: np.ndarray, fitted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One 64-bit code per fitted rotation: n x rotations unsigned numbers; missing bits of short vectors are 0."""
    out = np.zeros((len(units), len(fitted)), dtype="<u8")
    for r, (mean, projection) in enumerate(fitted):
        bits = ((units - mean) @ projection)[:, :64] >= 0
        padded = np.zeros((len(units), 64), dtype=bool)
        padded[:, :bits.shape[1]] = bits
        out[:, r] = np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _units(flat: np.ndarray, dims: int) -> np.ndarray:
    rows = flat.reshape(-1, dims)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def clean(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, key, label, vector and dims; vector and key are null where a row can link with nothing."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), values.alias("vector"))
    good = F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "vector", lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    rows = rows.withColumn("vector", F.when(good, F.col("vector")))
    return rows.withColumn("key", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))).withColumn("dims", F.size("vector"))


def _block(keys: np.ndarray, copies: np.ndarray, tiles: np.ndarray, parts: np.ndarray, units: np.ndarray, table: int, cross: bool, threshold: float):
    """Of one block of a bucket: per vector the copies linked to it here first, and the root of its links."""
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    if cross:
        linked &= tiles[:, None] != tiles[None, :]
    touched = linked.any(axis=1)
    if not touched.any():
        return None
    keys, copies, parts, linked = keys[touched], copies[touched], parts[touched], linked[np.ix_(touched, touched)]
    here = linked
    if table:  # a pair that agrees in an earlier part is counted there
        here = linked & ~(parts[:, None, :table] == parts[None, :, :table]).any(axis=2)
    root = np.arange(len(keys))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(keys)).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return keys, here @ copies, keys[root]


def link(distinct: DataFrame, threshold: float = THRESHOLD, rotations: int = ROTATIONS, part_bits: int = PART_BITS, sample: int = SAMPLE,
         tile: int = TILE) -> DataFrame:
    """(key, n, root) for vectors of ``distinct`` (key, label, vector, dims, copies): rows linked, added over the blocks.

    Summing n by key gives the rows linked to each row of that vector besides its own copies; (key, root) are edges
    that connect exactly what the links connect. The rotations are fitted on at most ``sample`` vectors per number of
    dimensions, those with the smallest hash. A bucket over ``tile`` vectors is cut into tiles by hash, and each pair
    of tiles is compared in a group of its own: all pairs of a bucket are looked at, none are written.
    """
    fitted = {}
    for row in distinct.select("dims").distinct().collect():
        d = row["dims"]
        chosen = distinct.where(F.col("dims") == d).orderBy("key").limit(sample).select("vector").collect()
        units = _units(np.array([x for c in chosen for x in c["vector"]]), d)
        fitted[d] = [fit_rotation(units, centre=r == 0, seed=7 + r) for r in range(rotations)]
    tables, per_code = rotations * (64 // part_bits), 64 // part_bits

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            parts = np.zeros((len(dims), tables), dtype=np.int64)
            for d in np.unique(dims):
                where = np.flatnonzero(dims == d)
                units = _units(batch.column(2).take(pa.array(where)).flatten().to_numpy(), int(d))
                code = codes(units, fitted[int(d)])
                for t in range(tables):
                    parts[where, t] = (code[:, t // per_code] >> np.uint64(t % per_code * part_bits)) & np.uint64((1 << part_bits) - 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * tables), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["key", "label", "vector", "dims", "copies", "parts"])

    flat = distinct.select("key", "label", "vector", "dims", "copies")
    label = distinct.schema["label"].dataType.simpleString()
    coded = materialise(flat.mapInArrow(encode, f"key bigint, label {label}, vector array<double>, dims int, copies bigint, parts array<bigint>"), "itq")
    places = coded.select("key", F.posexplode("parts").alias("t", "part"), "label", "dims")
    bucket = ["label", "dims", "t", "part"]
    sizes = places.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    met = places.join(sizes, bucket).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).withColumn("tile", F.pmod("key", "tiles").cast("int"))
    spread = met.select("key", *bucket, "tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(
        F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j")))).alias("pair"))
    blocks = spread.join(coded.select("key", "vector", "copies", "parts"), "key").groupBy(*bucket, "pair").agg(
        F.collect_list(F.struct("key", "copies", "tile", "parts", "vector")).alias("rows"))  # two tiles at most

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            rows, ends = lists.flatten(), np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
            keys, copies, tiles = (rows.field(n).to_numpy() for n in ("key", "copies", "tile"))
            parts = rows.field("parts").flatten().to_numpy().reshape(-1, tables)
            dims, table, cross = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            vectors, at, found = rows.field("vector").flatten().to_numpy(), 0, []
            for g in range(len(dims)):
                a, b = ends[g], ends[g + 1]
                size = (b - a) * dims[g]
                if b - a > 1:
                    found.append(_block(keys[a:b], copies[a:b], tiles[a:b], parts[a:b], _units(vectors[at:at + size], int(dims[g])), int(table[g]), bool(cross[g]), threshold))
                at += size
            found = [f for f in found if f is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(3)], names=["key", "n", "root"])

    return blocks.select("dims", "t", (F.col("pair.i") != F.col("pair.j")).alias("cross"), "rows").mapInArrow(compare, "key bigint, n bigint, root bigint")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **params) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Rows link if their labels are equal and not null and the cosine reaches the threshold. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are components of their own. Copies of a
    vector are compared once and counted as often as they stand. Vectors of different length never link. Null ids take
    part but name no component. Other columns are ignored; an empty table gives an empty result.
    """
    rows = materialise(clean(vectors, vec_id, vector, label), "vectors")
    distinct = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.first("dims").alias("dims"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct = materialise(distinct, "vectors-distinct")
    links = materialise(link(distinct, **params), "vectors-links")
    roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")), "vectors-components")
    named = distinct.select("key", "copies", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    counted = links.groupBy("key").agg(F.sum("n").alias("n"))
    facts = named.join(least, "root").join(counted, "key", "left").select(
        F.col("key").alias("_key"), "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    joined = rows.select("vec_id", "key").join(facts, F.col("key") == F.col("_key"), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
