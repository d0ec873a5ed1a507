"""Ranked lexical search in K2-treaps over the term-document grid.

The grid has a row for each term of the queries and a column for each document; a cell holds the impact of the term in
the document. A block of documents becomes one K2-treap: a quadtree whose levels list the cells that are not empty in
Z-order, four bits a cell for the quarters that go on below, and the highest impact in each cell. Child places are ranks
in the bits, so no pointers are kept, and maxima are stored as what they lack to that of the cell above.

A query descends from the whole block to single documents. A state is a range of documents with the cell of each query
term's row path; the weighted maxima of these cells add up to a bound on any score in the range. The states with the
highest bounds are split first, many at once as one array, and a range whose bound is below the k-th best score so far is
left alone. Blocks of a task pass this score on, so later blocks open fewer cells. All arithmetic is on integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_or_empty

TOP = 50
COLUMNS = 8_192
CELLS = 1_000_000
ITEMS_AT_ONCE = 2_000
STATES = 256
FEW = 16
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and all signs from U+0080 on, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8").translate(_SIGNS).split()


class Corpus(NamedTuple):
    """What scores need of all documents: ``documents`` with a term, ``length`` of all terms, weight of each query term."""

    documents: int
    length: int
    weights: dict[bytes, int]

    def damping(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * n * self.documents) // self.length


def impact(tf: np.ndarray, damping: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * damping)


def _spread(x: np.ndarray) -> np.ndarray:
    """The 32 lower bits of each number on the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap(NamedTuple):
    """Levels from the root to single cells: quarters that go on (four bits a cell), where they begin, and maxima."""

    quarters: list[np.ndarray]
    before: list[np.ndarray]
    maxima: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.maxima) - 1


_ONES = np.array([bin(b).count("1") for b in range(16)], dtype=np.int64)


def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> bytes:
    """The treap of a grid with ``values`` (above 0) at different places (row, column), as bytes."""
    depth = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
    code = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(code)
    code, value = code[order], values[order].astype(np.int64)
    levels = []
    for _ in range(depth):
        head = np.flatnonzero(np.r_[True, code[1:] >> np.uint64(2) != code[:-1] >> np.uint64(2)])
        quarter = np.add.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)), head).astype(np.uint8)
        above = np.maximum.reduceat(value, head)
        lack = np.repeat(above, np.diff(np.r_[head, len(code)])) - value
        levels.append((quarter, lack.astype("<u4")))
        code, value = code[head] >> np.uint64(2), above
    parts = [np.array([depth, int(value[0])], dtype="<i8").tobytes()]
    for quarter, lack in reversed(levels):
        parts += [np.array([len(quarter), len(lack)], dtype="<i8").tobytes(), quarter.tobytes(), lack.tobytes()]
    return b"".join(parts)


def load(data: bytes) -> Treap:
    depth, top = np.frombuffer(data, "<i8", 2).tolist()
    at, quarters, before, maxima = 16, [], [], [np.array([top], dtype=np.int64)]
    for _ in range(depth):
        n, m = np.frombuffer(data, "<i8", 2, at).tolist()
        quarter = np.frombuffer(data, np.uint8, n, at + 16)
        lack = np.frombuffer(data, "<u4", m, at + 16 + n)
        at += 16 + n + 4 * m
        size = _ONES[quarter]
        quarters.append(quarter)
        before.append(np.cumsum(size) - size)
        maxima.append(np.repeat(maxima[-1], size) - lack)
    return Treap(quarters, before, maxima)


def search(treap: Treap, rows: np.ndarray, weights: np.ndarray, documents: np.ndarray, best: list[tuple[int, int]], top: int = TOP) -> None:
    """Enter the documents of a block into ``best``, a heap of at most ``top`` pairs (score, -place in the order of ids).

    ``documents`` are these places by column, ascending. A pair enters if it is above the least of a full heap.
    """
    depth = treap.depth
    # waiting ranges by bound; each entry holds ranges of one level that were split together
    queue: list[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    number = 0

    def bounds(cells: np.ndarray, level: int) -> np.ndarray:
        return np.where(cells >= 0, treap.maxima[level][cells], 0) @ weights

    def wait(level: int, columns: np.ndarray, cells: np.ndarray, bound: np.ndarray) -> None:
        nonlocal number
        a, size = 0, FEW
        while a < len(columns):
            number += 1
            heapq.heappush(queue, (-int(bound[a]), -level, number, columns[a:a + size], cells[a:a + size], bound[a:a + size]))
            a, size = a + size, min(STATES, 2 * size)  # the best few go first, so that good scores come early

    inside = rows >> depth == 0
    root = np.where(inside, 0, -1)[None, :]
    wait(0, np.zeros(1, dtype=np.int64), root, bounds(root, 0))
    while queue:
        least = best[0][0] if len(best) == top else 1
        if -queue[0][0] < least:
            return
        _, level, _, columns, cells, bound = heapq.heappop(queue)
        level = -level
        open_ = bound >= least
        columns, cells = columns[open_], cells[open_]
        if level == depth:
            for score, column in zip(bound[open_].tolist(), columns.tolist()):
                entry = score, -int(documents[column])
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            continue
        bit = (rows >> (depth - 1 - level)) & 1
        some = cells >= 0
        quarter = np.where(some, treap.quarters[level][cells], 0)
        start = treap.before[level][cells]
        found = []
        for side in (0, 1):
            place = 2 * bit + side
            child = np.where(quarter >> place & 1, start + _ONES[quarter & ((1 << place) - 1)], -1)
            found.append((2 * columns + side, child))
        columns, cells = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        bound = bounds(cells, level + 1)
        order = np.argsort(-bound, kind="stable")
        order = order[:np.searchsorted(-bound[order], -least, side="right")]
        if len(order):
            wait(level + 1, columns[order], cells[order], bound[order])


def corpus_of(docs: DataFrame, wanted: list[bytes]) -> Corpus:
    """Counts over all documents, summed within a task first; at most one row a wanted term comes back."""
    sent = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(wanted)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        found, documents, length = np.zeros(len(known), dtype=np.int64), 0, 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                all_terms = terms(text)
                documents += bool(all_terms)
                length += len(all_terms)
                for t in known.keys() & set(all_terms):
                    found[known[t]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([documents, length, *found[some].tolist()], pa.int64())], names=["k", "n"])

    counted = docs.select(text_or_empty("text")).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    n = {r["k"]: r["n"] for r in counted.collect()}
    documents, length = n.get(-2, 0), n.get(-1, 0)
    return Corpus(documents, length, {t: math.floor(1_000 * math.log((2 * documents + 2) / (2 * n.get(k, 0) + 1))) for k, t in enumerate(wanted)})


def index(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """One row per block of documents: doc_ids (null last) by column, and the treap over the terms of ``corpus``.

    A block ends at ``COLUMNS`` documents or ``CELLS`` cells; documents without one of the terms have no column. Blocks
    are runs of rows of a task, so no text is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast((corpus._replace(weights={}), {t: k for k, t in enumerate(corpus.weights)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, known = sent.value
        ids: list[int | None] = []
        sizes: list[int] = []
        rows: list[int] = []
        tf: list[int] = []
        n: list[int] = []

        def block() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            column = np.empty(len(ids), dtype=np.int64)
            column[order] = np.arange(len(ids))
            cells = np.repeat(np.arange(len(ids)), sizes)
            values = impact(np.array(tf, dtype=np.int64), about.damping(np.array(n, dtype=np.int64))[cells])
            treap = build(np.array(rows, dtype=np.int64), column[cells], values)
            return pa.RecordBatch.from_arrays(
                [pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([treap], pa.binary())], names=["doc_ids", "treap"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count = Counter(terms(text))
                some = known.keys() & count.keys()
                if some:
                    ids.append(doc_id)
                    sizes.append(len(some))
                    rows += [known[t] for t in some]
                    tf += [count[t] for t in some]
                    n.append(count.total())
                if len(ids) >= COLUMNS or len(rows) >= CELLS:
                    yield block()
                    ids, sizes, rows, tf, n = [], [], [], [], []
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), text_or_empty("text")).mapInArrow(run, "doc_ids array<bigint>, treap binary")


def find(blocks: DataFrame, corpus: Corpus, items: list[list[bytes]], top: int = TOP) -> DataFrame:
    """item (its number), doc_id, score and place of the best ``top`` documents of each task for each item."""
    number = {t: k for k, t in enumerate(corpus.weights)}
    paths = [(k, np.array([number[t] for t in sorted(set(item))], dtype=np.int64), np.array([corpus.weights[t] for t in sorted(set(item))], dtype=np.int64))
             for k, item in enumerate(items) if item]
    sent = blocks.sparkSession.sparkContext.broadcast(paths)
    null_id = 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {k: [] for k, _, _ in sent.value}
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values.fill_null(null_id).to_numpy()
                treap = load(batch.column(1)[i].as_buffer())
                for k, rows, weights in sent.value:
                    search(treap, rows, weights, ids, best[k], top)
        rows = [(k, -place, score) for k, found in best.items() for score, place in found]
        if rows:
            k, ids, score = (np.array(c, dtype=np.int64) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids, mask=ids == null_id), pa.array(score)], names=["item", "doc_id", "score"])

    return blocks.select("doc_ids", "treap").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _best(rows: DataFrame, top: int, *within: str) -> DataFrame:
    order = Window.partitionBy(*within).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest score above 0 for each row of ``items``.

    Equal scores go by ascending doc_id, a null id last; documents that stand twice are ranked twice. Equal rows of
    ``items`` are one item, null ids stay; null texts have no terms, so such items have no rows and such documents
    are in none. Other columns are ignored. An empty table on either side gives no rows. Items are taken in blocks of
    about ``ITEMS_AT_ONCE``, each searched against all documents.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text").alias("text")).distinct()
    parts = max(1, math.ceil(asked.count() / ITEMS_AT_ONCE))
    found = None
    for part in range(parts):
        here = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        queries = [terms(r["text"]) for r in here]
        corpus = corpus_of(docs, sorted({t for q in queries for t in q}))
        blocks = materialise(index(docs, corpus), "treap-blocks")
        rows = find(blocks, corpus, queries, top).withColumn("_task", F.spark_partition_id() % 64)
        best = _best(_best(rows, top, "item", "_task"), top, "item")
        ids = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(here)], "item bigint, item_id bigint")
        done = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # a block of items
        found = done if found is None else found.unionByName(done)
    return found
