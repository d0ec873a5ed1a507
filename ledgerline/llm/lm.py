"""Language-model scores from an Elias-Fano n-gram trie.

All words, pairs and triples of the training texts are in the model. A level of the trie holds, for every n-gram in
order, its last word relative to its context: values rise over the whole level because each group starts where the one
before ended. Values and pointers to the next level are Elias-Fano coded, probabilities and the mass left to shorter
contexts are codes of a fixed step. N-grams are looked up by successor search inside the group of their context.

The trie is cut into shards of about ``SHARD`` tokens. A token (u, v, w) goes to the shard of its middle word v, which
then sees every triple around v, every context (u, v) and every pair (v, w), builds these levels and looks its tokens
up. A word v is frequent with more than an eighth of a shard or ``JOIN_SHARE`` of all tokens: its tokens go by (u, v),
and by (u, v, w) where that context has more than an eighth of a shard. What such a shard cannot count by itself is counted beforehand: the pairs of frequent words, of
which those above a share of all tokens are a level that every task holds (at most one entry per share) and the others
are joined, and the followers of frequent contexts. Words below a share get their exact count by a join.
"""

from __future__ import annotations

import math
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

WORD_SHARE = 1e-6
GRAM_WORD_SHARE = 1e-4
GRAM_SHARE = 1e-7
DISCOUNT = 0.75
STEPS = 32  # quantised probabilities are powers of 10 ** (-1 / STEPS)
CHUNK = 400_000
SHARD = 1_600_000  # tokens
ROWS_SENT = 50_000
JOIN_SHARE = 2e-3  # a share and not only a count, so that the part of the tokens that is joined hardly grows with them
TOKEN_BYTES = 5  # to set the number of shards
END = b""


class EliasFano:
    """A rising sequence of numbers in about 2 + log2(universe / n) bits each, with vectorised access and successor."""

    def __init__(self, values: np.ndarray | None = None, parts: dict[str, np.ndarray] | None = None) -> None:
        if parts is not None:
            self.parts = parts
        else:
            n = len(values)
            top = int(values[-1]) + 1 if n else 1
            width = max(0, int(math.log2(top / n))) if n else 0
            values = values.astype(np.uint64)
            low = values & np.uint64((1 << width) - 1)
            packed = np.zeros(n * width // 64 + 2, dtype=np.uint64)
            if width:
                at = np.arange(n, dtype=np.uint64) * np.uint64(width)
                word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
                np.bitwise_or.at(packed, word, low << shift)
                over = shift + np.uint64(width) > 64
                np.bitwise_or.at(packed, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
            ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
            upper = np.zeros((int(ones[-1]) if n else 0) // 64 + 2, dtype=np.uint64)
            np.bitwise_or.at(upper, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(upper).astype(np.int64))]).astype(np.uint32)
            self.parts = {"low": packed, "upper": upper, "before": before, "size": np.array([n, width], dtype=np.int64)}
        self.low, self.upper, self.before = self.parts["low"], self.parts["upper"], self.parts["before"]
        self.n, self.width = (int(x) for x in self.parts["size"])
        self.zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of each word."""
        at, left = np.zeros(len(word), dtype=np.int64), k.astype(np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count((word >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)).astype(np.int64)
            skip = left >= part
            left = np.where(skip, left - part, left)
            at += np.where(skip, half, 0)
        return at

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        high = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | high) & np.uint64((1 << self.width) - 1)

    @staticmethod
    def _places(words: np.ndarray) -> np.ndarray:
        """Places of all set bits."""
        return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))

    def get(self, i: np.ndarray) -> np.ndarray:
        if len(i) >= len(self.upper):
            ones = self._places(self.upper)[i]
        else:
            word = np.searchsorted(self.before, i, side="right") - 1
            ones = word * 64 + self._in_word(self.upper[word], i - self.before[word].astype(np.int64))
        return ((ones - i).astype(np.int64) << self.width) | self._lows(i).astype(np.int64)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have upper bits below ``high``: ones before the zero that closes the bucket before."""
        k = np.maximum(high - 1, 0)
        if len(high) >= len(self.upper):
            places = self._places(~self.upper)
            place = places[np.minimum(k, len(places) - 1)]
        else:
            word = np.minimum(np.searchsorted(self.zeros, k, side="right") - 1, len(self.upper) - 1)
            place = word * 64 + self._in_word(~self.upper[word], np.minimum(k - self.zeros[word], 63))
        return np.where(high > 0, np.minimum(place - k, self.n), 0)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the first value >= x in the bucket of its upper bits, the end of the bucket, the lower bits of x."""
        high = x >> self.width
        both = self._below(np.concatenate([high, high + 1]))
        a, end = both[:len(x)], both[len(x):]
        low = (x & ((1 << self.width) - 1)).astype(np.uint64)
        at, b = np.flatnonzero(a < end), end.copy()
        while len(at):
            middle = (a[at] + b[at]) >> 1
            less = self._lows(middle) < low[at]
            a[at[less]] = middle[less] + 1
            b[at[~less]] = middle[~less]
            at = at[a[at] < b[at]]
        return a, end, low

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if none)."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value equal to x, -1 if there is none."""
        at, end, low = self._search(x)
        hit = np.flatnonzero(at < end)
        hit = hit[self._lows(at[hit]) == low[hit]]
        found = np.full(len(x), -1)
        found[hit] = at[hit]
        return found


NONE = 65535  # the code of probability zero


def _quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down."""
    with np.errstate(divide="ignore"):
        return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEPS - 1e-9), 0, NONE - 1).astype(np.uint16)


_POWERS = 10.0 ** (-np.arange(NONE + 1) / STEPS)


class Level:
    """n-grams of one order, grouped by the position of their context in the level above.

    ``total`` is the count of every context, ``followers`` its different next words if there are others than those held.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, total: np.ndarray, discount: float, followers: np.ndarray | None = None) -> None:
        contexts = len(total)
        pointers = np.searchsorted(context, np.arange(contexts + 1))
        heads = np.r_[True, context[1:] != context[:-1]] if len(context) else np.empty(0, dtype=bool)
        tops = np.maximum.reduceat(word, np.flatnonzero(heads)) + 1 if len(context) else word
        base = np.r_[0, np.cumsum(tops)[:-1]] if len(context) else word
        self.words = EliasFano(base[np.cumsum(heads) - 1] + word if len(context) else word)
        self.pointers = EliasFano(pointers)
        self.codes = _quantise((count - discount) / total[context])
        if followers is None:
            followers = np.diff(pointers)
        # a context that was never seen leaves all of its mass
        self.left = np.where(total > 0, _quantise(discount * followers / np.maximum(total, 1)), 0).astype(np.uint16)

    @classmethod
    def mapped(cls, parts: dict[str, np.ndarray]) -> Level:
        level = cls.__new__(cls)
        for name in ("words", "pointers"):
            setattr(level, name, EliasFano(parts={k.split("/")[1]: v for k, v in parts.items() if k.startswith(name + "/")}))
        level.codes, level.left = parts["codes"], parts["left"]
        return level

    def arrays(self) -> dict[str, np.ndarray]:
        found = {f"{n}/{k}": v for n in ("words", "pointers") for k, v in getattr(self, n).parts.items()}
        return {**found, "codes": self.codes, "left": self.left}

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Position of (context, word), -1 if it is not held."""
        if not self.words.n:
            return np.full(len(word), -1)
        heads = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])[:len(context)]  # neighbours share their group
        group = context[heads]
        a, b = self.pointers.get(group), self.pointers.get(group + 1)
        base = np.where(a > 0, self.words.get(np.maximum(a - 1, 0)) + 1, 0)
        a, b, base = np.repeat(np.stack([a, b, np.where(a < b, base, 0)]), np.diff(np.r_[heads, len(context)]), axis=1)
        at = self.words.find(base + word)
        return np.where((at >= a) & (at < b), at, -1)


class Model:
    """Words of at least the word share with their counts, and the level of the pairs that start with a frequent word.

    ``pairs`` are all those pairs (v, w, code), ``contexts`` the (count, followers) of the frequent contexts by
    u * len(counts) + v.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, frequent: int, tokens: int, distinct: int, levels: list[Level],
                 pairs: DataFrame | None = None, contexts: dict[int, tuple[int, int]] | None = None, discount: float = DISCOUNT, shard: int = SHARD) -> None:
        self.words, self.counts, self.frequent, self.tokens, self.distinct = words, counts, frequent, tokens, distinct
        self.pairs, self.contexts, self.discount, self.shard = pairs, contexts or {}, discount, shard
        self.layout, pieces, at = [], [], 0
        for n, level in enumerate(levels):
            for name, array in level.arrays().items():
                raw = np.ascontiguousarray(array).tobytes()
                self.layout.append((n, name, array.dtype.str, len(array), at))
                pieces.append(raw + b"\0" * (-len(raw) % 8))
                at += len(pieces[-1])
        self.blob, self.order = b"".join(pieces) or b"\0", len(levels)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "pairs": None}  # a table stays with the driver

    def open(self) -> Model:
        """Map the levels into memory and index the words; once per process."""
        if not hasattr(self, "levels"):
            with tempfile.TemporaryFile() as file:  # has no name, goes with the process
                file.write(self.blob)
                file.flush()
                mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
            parts: list[dict] = [{} for _ in range(self.order)]
            for n, name, dtype, size, at in self.layout:
                parts[n][name] = np.frombuffer(mapped, dtype=dtype, count=size, offset=at)
            self.levels = [Level.mapped(p) for p in parts]
            self.number = {w: i for i, w in enumerate(self.words)}
            self.uni = (self.counts + 1) / (self.tokens + self.distinct + 1)
            self.words, self.blob = None, None
        return self

    def probability(self, ids: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token of a stream (-1 is no word of this model; ``lead`` marks the token before a text, which is context
        only): (a, b) with p = a + b * p_word by the pairs that every task holds, without those that are joined."""
        a, b = np.zeros(len(ids)), np.ones(len(ids))
        before = np.r_[-1, ids[:-1]]
        known = np.flatnonzero((before >= 0) & (before < self.frequent) & ~lead)
        level = self.levels[0]
        b[known] = _POWERS[level.left[before[known]]]
        ask = known[ids[known] >= 0]
        at = level.find(before[ask], ids[ask])
        a[ask[at >= 0]] = _POWERS[level.codes[at[at >= 0]]]
        return a, b


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def held_out() -> Column:
    """Documents that are not learnt from: crc32 of the id's text has remainder 2 by 7; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        texts = batch.column(0).to_pylist()
        for text in texts:
            counts.update(words_of(text))
        counts[END] = len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])


def _keys(words: list[bytes]) -> np.ndarray:
    """Codes of words below the word share: negative, 63 bits."""
    held = np.empty(len(words), dtype=object)
    held[:] = words
    return -1 - (hash_array(held, categorize=False) >> np.uint64(1)).astype(np.int64)


def _add_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_keys(batch.column(0).to_pylist()))], names=["word", "c", "key"])


def _streams(texts: list[str], number: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks (first text, tokens per text, codes with a lead end before every text, places of the leads)."""
    words: list[bytes] = []
    lengths, first = [], 0
    for i, text in enumerate(texts):
        before = len(words)
        words.append(END)
        words.extend(words_of(text))
        words.append(END)
        lengths.append(len(words) - before - 1)
        if len(words) >= CHUNK or i == len(texts) - 1:
            ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
            rare = np.flatnonzero(ids < 0)
            ids[rare] = _keys([words[k] for k in rare.tolist()])
            sizes = np.array(lengths, dtype=np.int64)
            yield first, sizes, ids, np.r_[0, np.cumsum(sizes + 1)[:-1]].astype(np.int64)
            words, lengths, first = [], [], i + 1


def _grams(ids: np.ndarray, heads: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two codes before every token and its own; ``none`` stands before a lead end."""
    lead = np.zeros(len(ids), dtype=bool)
    lead[heads] = True
    at = np.flatnonzero(~lead)
    return np.where(lead[at - 1], none, ids[at - 2]), ids[at - 1], ids[at]


def _counted(*columns: np.ndarray) -> list[np.ndarray]:
    """The different rows of ``columns`` and how often they occur."""
    order = np.lexsort(columns)
    columns = [x[order] for x in columns]
    heads = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in columns], axis=0)]) if len(order) else order
    return [*(x[heads] for x in columns), np.diff(np.r_[heads, len(order)])]


def train(docs: DataFrame, word_share: float = WORD_SHARE, gram_word_share: float = GRAM_WORD_SHARE, gram_share: float = GRAM_SHARE, discount: float = DISCOUNT,
          shard: int = SHARD) -> tuple[Model, DataFrame]:
    """Model and the counts of all words (word, c, key) from ``docs`` (text). The end of a text is the empty word.

    Words are frequent with at least ``gram_word_share`` of all tokens and an eighth of the ``shard`` tokens of a shard
    or ``JOIN_SHARE`` of all tokens.
    The shares and ``shard`` decide where an n-gram is looked up, not what is found.
    """
    spark = docs.sparkSession
    texts = docs.select(text_or_empty("text").alias("text"))
    counted = texts.mapInArrow(_count_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialise(counted.mapInArrow(_add_keys, "word binary, c bigint, key bigint"), "lm-words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = totals["n"], totals["v"]
    # at most 1 / word_share rows
    core = counts.where(F.col("c") >= max(1, math.ceil(word_share * tokens))).orderBy(F.desc("c"), "word").collect()
    words = [bytes(r["word"]) for r in core]
    count = np.array([r["c"] for r in core], dtype=np.int64)
    part = max(1, shard // 8)
    frequent = int((count >= max(1, math.ceil(gram_word_share * tokens), min(part, math.ceil(JOIN_SHARE * tokens)))).sum())
    if END in words[frequent:]:  # the end is always a context
        at = words.index(END)
        words.insert(0, words.pop(at))
        count = np.r_[count[at], np.delete(count, at)]
        frequent += 1
    elif words and END not in words:
        ends = counts.where(F.col("word") == F.lit(b"")).first()["c"]
        words.insert(0, END)
        count, frequent = np.r_[ends, count], frequent + 1
    if not words:
        return Model(words, count, 0, tokens, distinct, [], None, {}, discount, shard), counts
    size = len(words)
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, count[:frequent]))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (u = -1, v, w) with a frequent v and triples (u, v, w) with both frequent."""
        number, _ = shared.value
        for batch in batches:
            for _, _, ids, heads in _streams(batch.column(0).to_pylist(), number):
                u, v, w = _grams(ids, heads, size)
                often = np.flatnonzero((v >= 0) & (v < frequent))
                twice = often[(u[often] >= 0) & (u[often] < frequent)]
                u = np.r_[np.full(len(often), -1), u[twice]]
                both = np.r_[often, twice]
                u, v, w, c = _counted(u, v[both], w[both])
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(w), pa.array(c, pa.int64())], names=["u", "v", "w", "c"])

    def add_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, total = shared.value
        for batch in batches:
            v, c = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            codes = _quantise((c - discount) / total[v]).astype(np.int32)  # of pairs
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=["u", "v", "w", "c", "code"])

    summed = texts.mapInArrow(count_grams, "u int, v int, w bigint, c bigint").groupBy("u", "v", "w").agg(F.sum("c").alias("c"))
    grams = materialise(summed.mapInArrow(add_codes, "u int, v int, w bigint, c bigint, code int"), "lm-grams")
    pairs = grams.where("u < 0").select("v", "w", "c", "code")
    followers = np.zeros(frequent, dtype=np.int64)
    for r in pairs.groupBy("v").agg(F.count("*").alias("n")).collect():  # a row for each frequent word
        followers[r["v"]] = r["n"]
    # at most 1 / gram_share rows
    kept = pairs.where((F.col("w") >= 0) & (F.col("c") >= max(1, math.ceil(gram_share * tokens)))).select("v", "w", "c").toPandas().sort_values(["v", "w"])
    v, w, c = (kept[x].to_numpy(dtype=np.int64) for x in ("v", "w", "c"))
    level = Level(v, w, c, count[:frequent], discount, followers)
    # at most 8 rows for each shard
    hot = grams.where("u >= 0").groupBy("u", "v").agg(F.sum("c").alias("c"), F.count("*").alias("n")).where(F.col("c") >= part).collect()
    contexts = {r["u"] * size + r["v"]: (r["c"], r["n"]) for r in hot}
    return Model(words, count, frequent, tokens, distinct, [level], pairs, contexts, discount, shard), counts


def _mix(*parts: np.ndarray) -> np.ndarray:
    """A hash of the columns ``parts``."""
    x = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        x = (x ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second bytes, and so on: they compress better."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


RARE = 0xFFFFFFFF


def _pack(columns: list[np.ndarray], bounds: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, bytes) of the slices of ``columns`` between ``bounds`` that hold rows; negative numbers stand apart."""
    codec = pa.Codec("zstd", compression_level=1)
    rare = [np.r_[0, np.cumsum(x < 0)] for x in columns]
    keys = [x[x < 0] for x in columns]
    for part in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[part], bounds[part + 1]
        far = [k[r[a]:r[b]] for k, r in zip(keys, rare)]
        head = np.array([b - a, *map(len, far)], dtype=np.int64).tobytes()
        near = [_planes(np.where(x[a:b] < 0, RARE, x[a:b])) for x in columns]
        raw = b"".join([head, *near, *(k.tobytes() for k in far)])
        yield int(part), len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n, *far = np.frombuffer(raw, dtype=np.int64, count=1 + columns).tolist()
    at, found = 8 * (1 + columns), []
    for _ in range(columns):
        x = np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=at).reshape(4, n).T.copy().view(np.uint32).ravel()
        found.append(x.astype(np.int64))
        at += 4 * n
    for x, k in zip(found, far):
        x[x == RARE] = np.frombuffer(raw, dtype=np.int64, count=k, offset=at)
        at += 8 * k
    return found


ROW = pa.schema([("num", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                 ("w", pa.int64()), ("c", pa.int64()), ("v", pa.int32()), ("codes", pa.int64())])


def _rows(size: int, **columns: np.ndarray | pa.Array) -> pa.Table:
    return pa.table([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in ROW], schema=ROW)


def _shard_scores(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray, num: np.ndarray, learnt: np.ndarray) -> pa.Table:
    """Sums of the scores by document, and the tokens whose pair or word has to be joined, of all tokens of a shard."""
    none = len(model.counts)
    names, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    size, n = len(names), len(u)
    at = at.astype(np.int32)
    u_at, w_at = at[:n], at[n:]
    middle, v_at = np.unique(v, return_inverse=True)
    v_at = v_at.astype(np.int32)
    often = (middle >= 0) & (middle < model.frequent)

    def different(context: np.ndarray, word: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, place = np.unique(context.astype(np.int64) * size + word, return_inverse=True)
        return key // size, key % size, place.astype(np.int32), np.bincount(place[weights], minlength=len(key))

    # pairs (v, w) of words that are not frequent: all of them are here
    pv, pw, pair, c = different(v_at, w_at, learnt)
    total = np.bincount(v_at[learnt], minlength=len(middle))
    held = (c > 0) & ~often[pv]
    level = Level(pv[held], pw[held], c[held], np.where(often, 0, total), model.discount)
    left, code = level.left[pv], np.full(len(pv), NONE, dtype=np.uint16)
    found = level.find(pv, pw)
    code[found >= 0] = level.codes[found[found >= 0]]
    # pairs of frequent words: in the level that every task holds, or to be joined
    ask = often[pv]
    if ask.any():
        first = model.levels[0]
        left[ask] = first.left[middle[pv[ask]]]
        held = np.flatnonzero(ask & (names[pw] >= 0))
        found = first.find(middle[pv[held]], names[pw[held]])
        code[held[found >= 0]] = first.codes[found[found >= 0]]
        ask[held[found >= 0]] = False
    code[ask] = 0
    code2, left2 = code[pair], left[pair]
    asked = np.where(ask[pair], v, -1).astype(np.int32)
    del pv, pw, pair, level, code, left, found, held

    # contexts by their second word, then triples
    cv, cu, context, c = different(v_at, u_at, learnt)
    held = np.flatnonzero((c > 0) & (names[cu] != none))
    turned = Level(cv[held], cu[held], c[held], np.maximum(total, 1), model.discount)
    total, extra = c[held], None
    if model.contexts:
        extra = np.full(len(total), -1)
        first, second = names[cu[held]], middle[cv[held]]
        for i in np.flatnonzero((first >= 0) & (first < model.frequent) & (second >= 0) & (second < model.frequent)).tolist():
            key = int(first[i]) * none + int(second[i])
            if key in model.contexts:
                total[i], extra[i] = model.contexts[key]
    place = np.where(names[cu] != none, turned.find(cv, cu), -1)[context]
    inside = np.flatnonzero(place >= 0)
    place = place[inside]
    left3, code3 = np.zeros(n, dtype=np.uint16), np.full(n, NONE, dtype=np.uint16)
    del cv, cu, context, turned, u_at, v_at, at
    tc, tw, triple, c = different(place, w_at[inside], learnt[inside])
    held = c > 0
    if extra is not None:
        extra = np.where(extra < 0, np.bincount(tc[held], minlength=len(total)), extra)
    level = Level(tc[held], tw[held], c[held], total, model.discount, extra)
    left3[inside] = level.left[place]
    found = level.find(tc, tw)
    code3[inside] = np.where(found >= 0, level.codes[found] if len(level.codes) else NONE, NONE)[triple]
    del tc, tw, triple, level, found, place, inside, held

    near = (asked < 0) & (w >= 0)
    p = _POWERS[code3[near]] + _POWERS[left3[near]] * (_POWERS[code2[near]] + _POWERS[left2[near]] * model.uni[w[near]])
    documents, owner = np.unique(num[near], return_inverse=True)
    sums = _rows(len(documents), num=documents, score=np.bincount(owner, weights=np.log10(p), minlength=len(documents)))
    later = np.flatnonzero(~near)
    w, asked = w[later], asked[later]
    codes = sum(x[later].astype(np.int64) << bit for x, bit in ((code3, 0), (left3, 16), (code2, 32), (left2, 48)))
    count = model.counts[np.maximum(w, 0)] if none else w
    return pa.concat_tables([sums, _rows(len(w), num=num[later], w=w, c=pa.array(count, mask=w < 0), v=pa.array(asked, mask=asked < 0), codes=codes)])


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs`` (doc_id, text).

    ``model`` and ``counts`` come from the rows of ``docs`` that are not held out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size = docs.agg(F.sum(F.octet_length(text_or_empty("text")) + TOKEN_BYTES)).first()[0] or 0
    shards = max(1, math.ceil(size / TOKEN_BYTES / model.shard))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shared.value.open()
        none = len(opened.counts)
        contexts = np.array(sorted(opened.contexts), dtype=np.int64)
        number = TaskContext.get().partitionId() << 40  # of the next document
        for batch in batches:
            for first, lengths, ids, heads in _streams(batch.column(1).to_pylist(), opened.number):
                u, v, w = _grams(ids, heads, none)
                near = w >= 0
                base = np.zeros(len(w))
                base[near] = np.log10(opened.uni[w[near]])
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
                facts = {"num": np.arange(number, number + len(lengths)), "doc_id": batch.column(0).slice(first, len(lengths)), "n": lengths,
                         "known": np.add.reduceat(near.astype(np.int64), starts), "base": np.add.reduceat(base, starts)}
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ROW) as writer:
                    writer.write_table(_rows(len(lengths), **facts))
                often = (v >= 0) & (v < opened.frequent)
                part = _mix(v, np.where(often, u, 0))
                if len(contexts):
                    deep = (u >= 0) & (u < none) & often
                    deep[deep] = np.isin(u[deep] * none + v[deep], contexts)
                    part[deep] = _mix(v[deep], u[deep], w[deep])
                part = (part % np.uint64(shards)).astype(np.int64)
                learnt = batch.column(2).slice(first, len(lengths)).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(lengths)) * 2 + learnt, lengths)
                order = np.lexsort((v, part))
                bounds = np.searchsorted(part[order], np.arange(shards + 1))
                sent = list(_pack([x[order] for x in (u, v, w, owner)], bounds))
                # the documents' own rows go to a group beside the shards
                parts = [-1 - number % shards, *(p for p, _ in sent)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array([sink.getvalue().to_pybytes(), *(b for _, b in sent)], pa.binary())],
                    names=["shard", "first", "blob"])
                number += len(lengths)

    def run(group: pa.Table) -> pa.Table:
        blobs = group.column("blob").to_pylist()
        if group.column("shard")[0].as_py() < 0:
            return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])
        opened = shared.value.open()
        found = [_unpack(b, 4) for b in blobs]
        u, v, w = (np.concatenate([x.pop(0) for x in found]) for _ in range(3))
        num = np.concatenate([(x[0] >> 1) + n for x, n in zip(found, group.column("first").to_pylist())])
        learnt = np.concatenate([(x.pop() & 1).astype(bool) for x in found])
        del found, blobs
        scores = _shard_scores(opened, u, v, w, num, learnt)
        return pa.Table.from_batches(scores.to_batches(max_chunksize=ROWS_SENT), schema=ROW)

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), (~held_out()).alias("learnt")).mapInArrow(send, "shard int, first bigint, blob binary")
    rows = materialise(sent.groupBy("shard").applyInArrow(
        run, "num bigint, doc_id bigint, n bigint, known bigint, base double, score double, w bigint, c bigint, v int, codes bigint"), "lm-scores")

    late = rows.where("codes IS NOT NULL").select("num", "w", "c", "v", "codes")
    if model.pairs is not None:
        # the code of a pair that was not seen is that of probability zero
        paired = late.where("v IS NOT NULL").join(model.pairs.select("v", "w", "code"), ["v", "w"], "left").select(
            "num", "w", "c", "v", (F.col("codes") + F.shiftleft(F.coalesce("code", F.lit(NONE)).cast("long"), 32)).alias("codes"))
        late = late.where("v IS NULL").unionByName(paired)
    words = counts.groupBy(F.col("key").alias("w")).agg(F.sum("c").alias("total"))
    rare = late.where("w < 0").join(words, "w", "left").select("num", F.col("total").alias("c"), "codes", F.col("total").isNotNull().cast("long").alias("known"))
    p1 = (F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.tokens + model.distinct + 1))

    def power(bit: int) -> Column:
        return F.pow(F.lit(10.0), F.shiftrightunsigned("codes", bit).bitwiseAND(F.lit(65535)) / F.lit(-float(STEPS)))

    full = F.log10(power(0) + power(16) * (power(32) + power(48) * p1))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    parts = rows.where("codes IS NULL").select("num", "doc_id", "n", "known", "base", "score").unionByName(
        late.where("w >= 0").select("num", none.alias("doc_id"), zero.alias("n"), zero.alias("known"), F.lit(0.0).alias("base"), full.alias("score"))).unionByName(
        rare.select("num", none.alias("doc_id"), zero.alias("n"), "known", F.log10(p1).alias("base"), full.alias("score")))
    summed = parts.groupBy("num").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n", "known", "base", "score")])
    return summed.select(
        "doc_id", held_out().alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def language_scores(docs: DataFrame, **params) -> DataFrame:
    """Train on the documents that are not held out and score all rows of ``docs`` (doc_id, text).

    Null and empty texts are one end token. Repeated rows count and are scored each for itself. Other columns are
    ignored; an empty table gives no rows; if nothing can be learnt, all tokens are equally likely.
    """
    model, counts = train(docs.where(~held_out()).select("text"), **params)
    return score(docs.select("doc_id", "text"), model, counts)
