"""Packing token sequences by minimum bin slack.

Whole windows are cut off every document; what remains of each is shorter than a window. How many remainders there
are of each length is a table of at most ``capacity`` rows, whatever the number of documents. On it a bitset
subset-sum picks the multiset of lengths that comes closest to the capacity, counts are traced back, and the pattern
is used as often as the counts allow, until nothing is left. Documents then find their place by their rank among
those of the same length, so nothing but that table reaches the driver.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_merge, map_texts, materialise, text_or_empty

CAPACITY = 1024
END = 0
CACHE = 400_000
RANGES = 4_096
SPECIAL = "<|endoftext|>"


class ByteTokenizer:
    """Ids of a byte-level BPE for whole texts, with the ids of words kept between texts.

    ``path`` is a file of ranks (token in base 64, rank). A single blank between two signs that are not blank always
    begins a token and a lone line break always is one, so a text without double blanks is cut there and words are
    looked up; any other text is encoded as a whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import re

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._double = re.compile(r"\s\s|[\r\t\x0b\x0c\x1c-\x1f\x85\xa0  -     　]|^[ \n]|[ \n]$").search
        self._first: dict[str, bytes] = {}
        self._next: dict[str, bytes] = {}
        self._line = np.array(self._encode("\n"), dtype="<u4").tobytes()
        self._special = np.array([len(ranks)], dtype="<u4").tobytes()  # added behind the ranks

    def _words(self, known: dict[str, bytes], words: list[str], blank: str) -> bytes:
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = np.array(self._encode(blank + word), dtype="<u4").tobytes()
            return b"".join(map(known.__getitem__, words))

    def text_ids(self, text: str) -> bytes:
        """Ids of a whole text, with the added token at every literal ``SPECIAL`` and the pieces between encoded apart."""
        return self._special.join(map(self.ids, text.split(SPECIAL)))

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; a literal ``SPECIAL`` is text like any other."""
        if self._double(text):
            return np.array(self._encode(text), dtype="<u4").tobytes()
        if not text:
            return b""
        done = []
        for line in text.split("\n"):
            words = line.split(" ")
            done.append(self._words(self._first, words[:1], "") + self._words(self._next, words[1:], " "))
        return self._line.join(done)


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> ByteTokenizer:
    """The public byte-level vocabulary ``name``; a path with a slash is taken as it is. One per process."""
    if name not in _MADE:
        import public_tokenizers

        _MADE[name] = ByteTokenizer(name if "/" in name else public_tokenizers.path(name), public_tokenizers.PATTERN)
    return _MADE[name]


_MADE: dict[str, ByteTokenizer] = {}


def measure(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, end: int = END, kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``kept``, doc_tokens (the end included) and the CRC-32 of every full window and of the remainder, in order."""
    last = np.array([end], dtype="<u4").tobytes()

    def kernel(texts: list[str]) -> dict[str, list]:
        made, sizes, sums = tokenizer(vocabulary), [], []
        for text in texts:
            ids = made.text_ids(text) + last
            sizes.append(len(ids) // 4)
            view = memoryview(ids)
            sums.append([zlib.crc32(view[i:i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
        return {"doc_tokens": sizes, "crcs": sums}

    return map_texts(docs.select("doc_id", *kept, text_or_empty("text").alias("text")), kernel, "doc_tokens bigint, crcs array<bigint>")


def best_multiset(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Length -> number for a window: the longest available length and the multiset that fills the rest best.

    ``counts[l]`` is how many of length l there are. Bit s of the set says that sum s can be made; a length with many
    copies enters in groups of 1, 2, 4, ... copies. Longer lengths enter first, so few and long ones are preferred.
    """
    longest = int(np.flatnonzero(counts)[-1])
    chosen, room = {longest: 1}, capacity - longest
    sums, steps = 1, []
    full = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        left, group = min(int(counts[length]) - (length == longest), room // length), 1
        while left > 0:
            group = min(group, left)
            steps.append((sums, length, group))
            sums |= (sums << (length * group)) & full
            left -= group
            group *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    for before, length, group in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + group
            at -= length * group
    return chosen


def plan_remainders(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> number per sequence) with the number of sequences each fills; uses every remainder once.

    A pattern is repeated as often as its counts allow, so a length runs out with every step and there are at most a
    few thousand patterns, whatever the counts.
    """
    left = np.zeros(capacity, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        pattern = best_multiset(left, capacity)
        times = min(int(left[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] -= n * times
        plan.append((pattern, times))
    return plan


def _rank(rows: DataFrame, key: str) -> DataFrame:
    """Add ``rank`` (from 0) within ``key`` by ``_order``, in the ranges ``_range`` so that no key meets in one task."""
    cut = rows
    before = cut.groupBy(key, "_range").agg(F.count("*").alias("n")).withColumn(
        "_before", F.sum("n").over(Window.partitionBy(key).orderBy("_range")) - F.col("n")).select(key, "_range", "_before")
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_range").orderBy("_order", "doc_id", "crcs")))
    return ranked.join(before, [key, "_range"]).withColumn("rank", F.col("_before") + F.col("_rank") - 1).drop("_range", "_rank", "_before", "_order")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, end: int = END, place: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end token. Repeated rows are packed each for itself; null ids are kept; other
    columns are ignored; an empty table gives no pieces. Sequence ids are dense: first those of remainders, then
    the full windows. Remainders are not cut again, so if nearly all exceed half a window, padding stays.
    With ``place``, a column that numbers the rows from 0, documents of a length are used in its order and sequences
    are numbered by the first place in them.
    """
    spark = docs.sparkSession
    sized = materialise(measure(docs, vocabulary, capacity, end, (place,) if place else ()), "packing").withColumn("rest", F.col("doc_tokens") % capacity)
    if place:
        total = sized.count()
        ranges = lambda c: F.floor(c * RANGES / F.lit(max(1, total)))
        sized = sized.withColumn("_order", F.col(place)).withColumn("_range", ranges(F.col(place)))
    else:
        sized = sized.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_range", F.substring("_order", 1, 3))
    at_place = [place] if place else []
    # at most ``capacity`` rows
    counts = {row["rest"]: row["n"] for row in sized.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    rows, sequences, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan_remainders(counts, capacity):
        offset = 0
        for length, n in pattern.items():
            rows.append((length, used[length], n, times, sequences, offset))
            used[length] += n * times
            offset += length * n
        sequences += times
    plan = spark.createDataFrame(rows, "rest bigint, from_rank bigint, per_sequence bigint, times bigint, first_sequence bigint, first_offset bigint")
    # one array per length keeps the join an equi-join; its size depends on the capacity alone
    steps = plan.groupBy("rest").agg(F.array_sort(F.collect_list(F.struct("from_rank", "per_sequence", "times", "first_sequence", "first_offset"))).alias("steps"))
    tails = _rank(sized.where("rest > 0"), "rest").join(F.broadcast(steps), "rest")
    at = F.element_at(F.filter("steps", lambda s: s["from_rank"] <= F.col("rank")), -1)
    tails = tails.withColumn("s", at).withColumn("i", F.col("rank") - F.col("s.from_rank")).select(
        *at_place, "doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens",
        (F.col("s.first_sequence") + F.floor(F.col("i") / F.col("s.per_sequence"))).alias("sequence_id"),
        (F.col("s.first_offset") + F.col("i") % F.col("s.per_sequence") * F.col("rest")).alias("offset"))
    long = sized.withColumn("windows", F.floor(F.col("doc_tokens") / capacity)).where("windows > 0")
    before = long.groupBy("_range").agg(F.sum("windows").alias("n")).withColumn(
        "_before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("n")).select("_range", "_before")  # 4,096 rows
    numbered = long.withColumn("_in", F.sum("windows").over(Window.partitionBy("_range").orderBy("_order", "doc_id", "crcs").rowsBetween(Window.unboundedPreceding, -1)))
    windows = numbered.join(before, "_range").withColumn("base", F.col("_before") + F.coalesce("_in", F.lit(0)) + sequences).select(
        *at_place, "doc_id", "doc_tokens", "base", F.posexplode(F.expr("slice(crcs, 1, int(windows))")).alias("w", "ids_crc32"))
    full = windows.select(*at_place, "doc_id", (F.col("w") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
                          (F.col("base") + F.col("w")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = tails.unionByName(full)
    if not place:
        return pieces
    pieces = materialise(pieces, "packing-pieces")
    first = pieces.groupBy("sequence_id").agg(F.min(F.struct(place, "start")).alias("_order")).withColumn("_range", ranges(F.col(f"_order.{place}")))
    before = first.groupBy("_range").agg(F.count("*").alias("n")).withColumn(
        "_before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("n")).select("_range", "_before")  # 4,096 rows
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy("_order"))).join(before, "_range").select(
        "sequence_id", (F.col("_before") + F.col("_rank") - 1).alias("_new"))
    return pieces.join(by_merge(ranked), "sequence_id").withColumn("sequence_id", F.col("_new")).drop("_new", place)
