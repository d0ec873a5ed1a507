"""SimHash near-duplicates with covering locality-sensitive hashing.

Every bit position i gets a vector m(i) of radius + 1 bits. For each non-zero vector v the mask keeps the bits whose
m(i) has an odd product with v. Any ``radius`` positions have a v orthogonal to all of them, so two fingerprints that
differ in at most ``radius`` bits agree under at least one of the 2**(radius + 1) - 1 masks: no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_merge, components, map_texts, materialise, text_or_empty

RADIUS = 4
SHINGLE = 4
SEED = 42
IN_TASK = 20_000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``size`` words; 0 without words."""
    words = text.encode("utf-8").lower().split()  # bytes: lowers A-Z only, splits at the six ASCII blanks
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:1 - size].tolist(), ends[size - 1:].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at:at + 16_384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``columns`` of ``docs`` and ``fp`` (the fingerprint's bits as bigint); null texts count as empty."""

    def kernel(texts: list[str]) -> dict[str, list]:
        values = np.array([fingerprint(t, size) for t in texts], dtype="<u8")
        return {"fp": values.view("<i8")}

    return map_texts(docs.select(*columns, text_or_empty(text).alias(text)), kernel, "fp bigint", text)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks as signed 64-bit numbers. m(i) runs through all non-zero vectors, so masks have even weights."""
    dims = radius + 1
    vectors = [i % (2**dims - 1) + 1 for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2**dims)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for members linked to another one; visits each member once against those not yet reached."""
    left = np.unique(members)
    nodes, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                reached, left = left[near], left[~near]
                frontier.extend(reached)
                nodes.append(reached)
                roots.append(np.full(len(reached), root))
    if not nodes:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(nodes), np.concatenate(roots)


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, in_task: int = IN_TASK) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints of ``distinct`` (fp) reachable by steps of ``radius`` bits.

    Buckets of at most ``in_task`` fingerprints are resolved inside a task, which returns a spanning forest instead
    of pairs. In larger buckets every fingerprint is joined to the points at most radius / 2 bits away: two of them
    share such a point exactly if they are within ``radius`` (even radius), so the rows grow with the members.
    """
    tables = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])).alias("v", "key"))
    shared = tables.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(tables.join(by_merge(shared), ["v", "key"]), "simhash-buckets")
    lists = (
        members.where(F.col("n") <= in_task).groupBy("v", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
        .groupBy("fps").agg(F.lit(1).alias("one")).select("fps"))  # the same group shows up in many tables

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_forest(np.array(fps, dtype="<i8").view("<u8"), radius) for fps in batch.column(0).to_pylist()]
            a = np.concatenate([f[0] for f in found] or [np.empty(0, np.uint64)]).view("<i8")
            b = np.concatenate([f[1] for f in found] or [np.empty(0, np.uint64)]).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    near = lists.mapInArrow(forests, "a bigint, b bigint")
    if radius % 2:
        raise ValueError("the radius must be even")
    steps = [0]
    for _ in range(radius // 2):
        steps = sorted({s ^ (1 << i) for s in steps for i in range(64)} | set(steps))
    steps = [s - (1 << 64) if s >> 63 else s for s in steps]
    crowded = members.where(F.col("n") > in_task).select("fp").distinct()
    points = crowded.select("fp", F.explode(F.transform(F.array(*[F.lit(s) for s in steps]), lambda s: F.col("fp").bitwiseXOR(s))).alias("z"))
    lowest = points.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
    far = points.join(by_merge(lowest), "z").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.union(far).distinct() if _any(members, in_task) else near.distinct()


def _any(members: DataFrame, in_task: int) -> bool:
    return bool(members.where(F.col("n") > in_task).head(1))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, ``text_hash``, ``fp``, ``component_id`` and ``group_fp`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links of at most ``radius`` differing bits, ``group_fp`` the
    smallest fingerprint of the group. Empty and null texts have fingerprint 0 and are linked like any other. Null
    ids take part but never name a group unless all its ids are null. Repeated rows stay rows. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), F.col(text).alias("text"))
    known = materialise(fingerprints(rows, ["doc_id", "text_hash"], "text", size), "simhash")
    per_fp = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = materialise(components(link_fingerprints(per_fp.select("fp"), radius), "simhash-components"), "simhash-roots")
    grouped = per_fp.join(by_merge(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("group_fp"))
    named = grouped.join(by_merge(grouped.groupBy("group_fp").agg(F.min("least").alias("component_id"))), "group_fp").select("fp", "group_fp", "component_id")
    return known.join(by_merge(named), "fp").select("doc_id", "text_hash", "fp", "component_id", "group_fp")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One row of ``docs`` (doc_id, text, ...) per near-duplicate group: that of the smallest doc_id, null ids last."""
    return one_of(docs, near_groups(docs, **params), "group_fp")


def one_of(docs: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The row of the smallest doc_id, null ids last, for each ``key`` of ``groups`` (doc_id, text_hash, key).

    Rows equal in doc_id and text are one; other columns stay as they are, whatever their names; an empty table stays empty.
    """
    first = groups.groupBy(key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("w"))
    winners = first.select(F.col("w.doc_id").alias("w_id"), F.col("w.text_hash").alias("w_hash")).distinct()
    # the row travels as one column, so its names clash with none here
    rows = docs.select("doc_id", F.xxhash64(text_or_empty("text")).alias("hash"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(by_merge(winners), rows["doc_id"].eqNullSafe(winners["w_id"]) & (rows["hash"] == winners["w_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "hash"]).select("row.*")


def as_hex(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
