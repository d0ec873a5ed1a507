"""Removal of repeated passages by prefix-free parsing.

A window of ``size`` bytes is repeated if the same bytes start anywhere else in the corpus. The text of every document
is cut into phrases by triggers: places where a rolling hash is the smallest of its surroundings. A trigger depends
on its own few bytes alone, so equal text is cut alike wherever it stands. Each phrase begins and ends with a trigger
string. The corpus is then a dictionary of distinct phrases and a parse, the sequence of phrases.

Suffixes of the corpus that share ``size`` bytes are neighbours in corpus order exactly if they agree in the rest of
their first phrase (a suffix of a dictionary phrase) and in the parse that follows, as far as ``size`` bytes reach.
Only this equality is needed here, so instead of sorting all suffixes the two parts are grouped by hash:

1. A window is filed under the first phrase it holds whole. A phrase that occurs once in the parse settles all its
   windows: they are unique.
2. Windows filed under one occurrence of a phrase are a run of suffixes of the phrase before, continued by the same
   parse. If the bytes that the whole run spans occur twice, all its windows are repeated.
3. What is left are runs at the ends of repeated passages, and one run for each different span of the same phrase to
   hold them against. Their windows, and windows that hold no whole phrase, are compared one by one.

Rows follow the phrases and not the bytes: equal phrases of a batch of documents are one row before the shuffle, and
no group is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_or_empty

SIZE = 200
GRAM = 8
SIDE = 20
_RNG = np.random.default_rng(90210)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_A, _B, _C, _D = (int(x) * 2 + 1 for x in _RNG.integers(1, 2**62, 4))


def triggers(data: np.ndarray, gram: int = GRAM, side: int = SIDE) -> np.ndarray:
    """Starts of trigger strings: ``side`` bytes, a gram whose rolling hash is the first smallest among its 2 * side + 1 neighbours, ``side`` bytes."""
    if len(data) < gram + 2 * side:
        return np.empty(0, dtype=np.int64)
    h = _BYTES[data]
    span = 1
    for factor in (_A, _B, _C):  # doubling: 2, 4, 8 bytes
        h = h[:-span] * np.uint64(factor) + h[span:]
        span *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_D)
    h ^= h >> np.uint64(29)
    low, width = h, 1
    while 2 * width <= side:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (side - width)], low[side - width:])  # smallest of ``side`` from each place
    n = len(h) - 2 * side
    centre = h[side:side + n]
    return np.flatnonzero((centre < low[:n]) & (centre <= low[side + 1:side + 1 + n])).astype(np.int64)


def runs(data: np.ndarray, size: int = SIZE, gram: int = GRAM, side: int = SIDE) -> tuple[np.ndarray, ...]:
    """Per phrase that files windows: its start, end, and the first and last start of a window filed under it; a flag
    per window start that is filed under none; and start and end of the phrases that file no window."""
    n = len(data) - size + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, np.empty(0, dtype=bool), none, none
    t = triggers(data, gram, side)
    start, end = t[:-1], t[1:] + gram + 2 * side
    before = np.concatenate([[-1], t[:-2]]) if len(start) else start
    first = np.maximum(before + 1, np.maximum(end - size, 0))
    last = np.minimum(start, n - 1)
    some = first <= last
    idle = start[~some], end[~some]
    start, end, first, last = start[some], end[some], first[some], last[some]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    return start, end, first, last, np.cumsum(edge[:n]) == 0, *idle


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and a key of 64 and 32 bits over both: k1, k2. Rows that agree in it are the same document twice."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.hash(F.col("doc_id").isNull(), "doc_id", "text"))


def _phrases(size: int):
    """Rows (phrase, n, places) of a batch: each distinct phrase once, with all its places packed."""
    place = np.dtype([("span", "<i8"), ("k1", "<i8"), ("k2", "<i4"), ("first", "<i4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            phrases, spans, firsts, owners = [], [], [], []
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode("utf-8")
                start, end, first, last, _, idle_start, idle_end = runs(np.frombuffer(data, dtype=np.uint8), size)
                # phrases that file no window count too: other windows may hold them
                phrases += [digest(data[a:b]) for a, b in zip(np.r_[start, idle_start].tolist(), np.r_[end, idle_end].tolist())]
                spans += [digest(data[a:b], 1) for a, b in zip(first.tolist(), (last + size).tolist())] + [0] * len(idle_start)
                firsts.append(np.r_[first, np.full(len(idle_start), -1)])
                owners.append(np.full(len(firsts[-1]), i))
            if not phrases:
                continue
            owner, phrase = np.concatenate(owners), np.array(phrases, dtype=np.uint64)
            places = np.empty(len(phrase), dtype=place)
            places["span"], places["k1"], places["k2"], places["first"] = np.array(spans, dtype=np.uint64).view(np.int64), k1[owner], k2[owner], np.concatenate(firsts)
            order = np.argsort(phrase, kind="stable")
            phrase, packed = phrase[order], places[order].tobytes()
            heads = np.flatnonzero(np.r_[True, phrase[1:] != phrase[:-1]])
            offsets = np.r_[heads, len(phrase)]
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer((offsets * place.itemsize).astype(np.int32)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([pa.array(phrase[heads].view(np.int64)), pa.array(np.diff(offsets)), binary], names=["phrase", "n", "places"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, data = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            rows = np.frombuffer(b"".join(data), dtype=place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), counts)), *[pa.array(np.ascontiguousarray(rows[c])) for c in ("span", "k1", "k2", "first")]],
                names=["phrase", "span", "k1", "k2", "first"])

    return run, unpack


def _open_windows(data: np.ndarray, size: int, marked: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows still open in a document, and how many windows of the corpus each stands for.

    ``marked`` are the places of repeated phrases, ``opened`` above 0 where the windows filed there are open.
    """
    start, end, first, last, loose, _, _ = runs(data, size)
    n = len(loose)
    weight = loose.astype(np.int64)
    if n and len(marked):
        known, count = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        known[marked] = True
        np.maximum.at(count, marked, opened)
        again = known[first]
        once = np.zeros(n + 1, dtype=np.int64)  # windows that hold a phrase found nowhere else
        np.add.at(once, np.maximum(end[~again] - size, 0), 1)
        np.add.at(once, np.minimum(start[~again], n - 1) + 1, -1)
        free = np.cumsum(once[:n]) == 0
        filed = np.flatnonzero(again & (count[first] > 0))
        length = last[filed] - first[filed] + 1
        places = np.arange(length.sum()) + np.repeat(first[filed] - (np.cumsum(length) - length), length)
        weight[places] = np.where(free[places], np.repeat(count[first[filed]], length), 0)
    places = np.flatnonzero(weight)
    return places, weight[places]


def _windows(size: int):
    """Rows (k1, k2, digest, n, starts) for the windows still open in a document, equal ones of a document together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches):
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marks = batch.column(3)
            bounds, marked, opened = marks.offsets.to_numpy(), *(marks.values.field(f).to_numpy() for f in ("first", "open"))
            owner, keys, starts, weights = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode("utf-8")
                mine = slice(bounds[i], bounds[i + 1])
                places, weight = _open_windows(np.frombuffer(data, dtype=np.uint8), size, marked[mine], opened[mine])
                keys += [digest(data[s:s + size]) for s in places.tolist()]
                owner.append(np.full(len(places), i))
                starts.append(places)
                weights.append(weight)
            if not keys:
                continue
            whose, at, n = np.concatenate(owner), np.concatenate(starts).astype("<i4"), np.concatenate(weights)
            halves = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
            order = np.lexsort((at, halves[:, 1], halves[:, 0], whose))
            whose, at, n, halves = whose[order], at[order], n[order], np.ascontiguousarray(halves[order])
            head = np.flatnonzero(np.r_[True, (whose[1:] != whose[:-1]) | (halves[1:] != halves[:-1]).any(axis=1)])
            grouped = pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((4 * np.r_[head, len(at)]).astype(np.int32)), pa.py_buffer(at.tobytes())])
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(head), [None, pa.py_buffer(halves[head].tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(k1[whose[head]]), pa.array(k2[whose[head]]), key, pa.array(np.add.reduceat(n, head)), grouped],
                                             names=["k1", "k2", "digest", "n", "starts"])

    return run


def _cut(size: int):
    """Remove the repeated windows of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, full, starts in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                data = text.encode("utf-8")
                rest, gone, parts = data, 0, 0
                if full or starts:
                    array = np.frombuffer(data, dtype=np.uint8)
                    edge = np.zeros(len(data) + 1, dtype=np.int64)
                    if full:
                        _, _, first, last, _, _, _ = runs(array, size)
                        where = np.isin(first, np.array(full))
                        np.add.at(edge, first[where], 1)
                        np.add.at(edge, last[where] + size, -1)
                    if starts:
                        at = np.frombuffer(b"".join(starts), dtype="<i4")
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + size, -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone, parts = int(cover.sum()), int((cover & ~np.r_[False, cover[:-1]]).sum())
                    rest = array[~cover].tobytes()
                sizes.append(len(data))
                removed.append(gone)
                spans.append(parts)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array([sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) for every row of ``docs``.

    Every byte covered by a ``size``-byte string that also starts anywhere else, in the same text or another, goes.
    Matches never cross documents and are judged on the input. Null texts count as empty; texts shorter than ``size``
    stay whole; a document that stands twice repeats all of itself. Other columns are ignored; an empty table gives
    an empty result.
    """
    keyed = _keyed(docs, doc_id, text)
    pack, unpack = _phrases(size)
    parse = keyed.select("k1", "k2", "text").mapInArrow(pack, "phrase bigint, n bigint, places binary")
    dictionary = parse.withColumn("total", F.sum("n").over(Window.partitionBy("phrase"))).where("total > 1").select("phrase", "n", "places")
    again = materialise(dictionary.mapInArrow(unpack, "phrase bigint, span bigint, k1 bigint, k2 int, first int").where("first >= 0"), "repeats-phrases")
    spans = materialise(again.groupBy("phrase", "span").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first")).alias("one")), "repeats-spans")
    various = spans.groupBy("phrase").agg(F.count("*").alias("kinds")).where("kinds > 1").select("phrase")
    open_runs = spans.join(various, "phrase").select("one.k1", "one.k2", "one.first", F.col("n").alias("open"))
    full = again.join(spans.where("n > 1").select("phrase", "span"), ["phrase", "span"]).select("k1", "k2", "first")
    # sets are bounded by the length of one text, however often its row stands there
    marks = again.select("k1", "k2", "first", F.lit(0).cast("bigint").alias("open")).unionByName(open_runs).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("first", "open")).alias("marks"))
    texts = keyed.select("doc_id", "k1", "k2", "text")
    open_windows = texts.join(marks, ["k1", "k2"], "left").select("k1", "k2", "text", "marks").mapInArrow(
        _windows(size), "k1 bigint, k2 int, digest binary, n bigint, starts binary")
    repeated = materialise(open_windows.withColumn("total", F.sum("n").over(Window.partitionBy("digest"))).where("total > 1").select("k1", "k2", "starts"), "repeats-windows")
    lists = full.select("k1", "k2", "first", F.lit(None).cast("binary").alias("starts")).unionByName(
        repeated.select("k1", "k2", F.lit(None).cast("int").alias("first"), "starts")).groupBy("k1", "k2").agg(
        F.collect_set("first").alias("full"), F.collect_set("starts").alias("starts"))
    return texts.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "full", "starts").mapInArrow(
        _cut(size), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
