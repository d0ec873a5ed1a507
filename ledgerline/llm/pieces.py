"""SentencePiece encoding and decoding by vectorised merge rounds.

A byte-fallback BPE model joins, again and again, the neighbouring symbols whose joint piece scores best, the leftmost
first. No piece of the vocabulary has a blank sign behind another sign, so no merge crosses that place and a text falls
into words that are encoded apart. Punctuation is cut off likewise, with all signs that share a piece with it. All new words of a batch lie in one flat array of symbols. Each round finds the best
rank in every word by a segmented minimum, merges its places from the left in all words at once, and compacts the
array; words without a pair left leave it.

Merging several places of a word in one round equals merging them one after the other only if no piece made of the new
symbol ranks as high. Where the vocabulary cannot promise that, the round merges the leftmost place alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, text_or_empty

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
LONG = 256
CACHE = 300_000
_NONE = np.iinfo(np.int64).max


class PieceModel:
    """Encoder and decoder over the pieces, scores and types of a SentencePiece BPE model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path)
        n = read.get_piece_size()
        self.pieces = [read.id_to_piece(i) for i in range(n)]
        self.end, self.unknown = read.eos_id(), read.unk_id()
        self.silent = frozenset(i for i in range(n) if read.is_control(i))
        byte_ids = [i for i in range(n) if read.is_byte(i)]
        self.byte_value = {i: int(self.pieces[i][3:5], 16) for i in byte_ids}
        if read.normalize("ﬁ  Å ") != f"{BLANK}ﬁ{BLANK}{BLANK}Å{BLANK}" or len(byte_ids) != 256 or any(read.is_unused(i) for i in range(n)):
            raise ValueError("needs a model with byte fallback, a leading blank and no other normalisation")
        self.byte_id = {self.byte_value[i]: i for i in byte_ids}
        normal = {p: i for i, p in enumerate(self.pieces) if i not in self.byte_value and i not in self.silent and i != self.unknown}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in normal):
            raise ValueError("needs a model whose pieces hold blanks in front only")
        self.single = {p: i for p, i in normal.items() if len(p) == 1}
        levels = sorted({read.get_score(i) for i in normal.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(levels)}
        # every way to make a piece of two others, sorted by (left, right) for the lookup of pairs
        made = sorted((normal[p[:k]] * n + normal[p[k:]], rank[read.get_score(i)], i)
                      for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal)
        self.n = n
        self.pair_key, self.pair_rank, self.pair_piece = (np.array(c, dtype=np.int64) for c in zip(*made))
        # best rank of any pair that a piece takes part in; joining many places at once is safe below it
        best = np.full(n, _NONE)
        np.minimum.at(best, self.pair_key // n, self.pair_rank)
        np.minimum.at(best, self.pair_key % n, self.pair_rank)
        self.safe = best[self.pair_piece] > self.pair_rank
        # ``_NONE`` and True stand behind the last pair, where the number -1 of no pair finds them
        self.pair_rank, self.safe = np.r_[self.pair_rank, _NONE], np.r_[self.safe, True]
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in self.single.items():
            self.symbol[ord(p)] = i
        marks = "".join(map(re.escape, sorted(_signs_with(".", normal))))
        line = "\n" if "\n" not in "".join(p for p in normal if len(p) > 1) else ""
        self._words = re.compile(f"{BLANK}*[{marks}]+|{BLANK}*[^{BLANK}{marks}{line}]+|{BLANK}+" + ("|\n" if line else "")).findall
        self.plain = [p.replace(BLANK, " ") for p in self.pieces]
        self.number = list(map(str, range(n)))

    def words(self, text: str) -> list[str]:
        """The parts of a text, blanks escaped and one put in front, that no merge crosses."""
        return self._words(BLANK + text.replace(" ", BLANK)) if text else []

    def _find(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the pair that begins at each place ``at``, or -1; symbols below zero are in no pair."""
        left, right = symbols[at], symbols[at + 1]
        key = left * self.n + right
        found = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[found] == key) & (left >= 0) & (right >= 0) & (owner[at] == owner[at + 1]), found, -1)

    def encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all words one behind another and the end of each word, by merge rounds over all of them."""
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        pair = np.r_[self._find(symbols, owner, np.arange(len(symbols) - 1)), -1][:len(symbols)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = self.pair_rank[pair]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            width = np.diff(np.r_[starts, len(symbols)])
            places = np.flatnonzero((rank == np.repeat(best, width)) & (pair >= 0))
            word = np.searchsorted(starts, places, side="right") - 1
            careful = np.zeros(len(starts), dtype=bool)
            careful[word[~self.safe[pair[places]]]] = True
            # in a careful word only the first place counts, elsewhere every second one of places in a row
            first = np.r_[True, word[1:] != word[:-1]][:len(places)]
            row = first | np.r_[True, places[1:] != places[:-1] + 1][:len(places)]
            since = np.arange(len(places)) - np.maximum.accumulate(np.where(row, np.arange(len(places)), 0))
            take = places[np.where(careful[word], first, since % 2 == 0)]
            by_heap = careful & (width > LONG)
            for s in np.flatnonzero(by_heap).tolist():
                a, b = starts[s], starts[s] + width[s]
                rest = np.array(self._merge_one_by_one(symbols[a:b].tolist()), dtype=np.int64)
                done.append((np.full(len(rest), owner[a]), rest))
            finished = np.repeat(best == _NONE, width)
            done.append((owner[finished], symbols[finished]))
            symbols[take] = self.pair_piece[pair[take]]
            keep = ~(finished | np.repeat(by_heap, width))
            alive = take[keep[take]]
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            changed = np.concatenate([place[alive], np.maximum(place[alive] - 1, 0)])
            pair[changed[changed == len(symbols) - 1]] = -1
            changed = changed[changed < len(symbols) - 1]
            pair[changed] = self._find(symbols, owner, changed)
        owners = np.concatenate([d[0] for d in done]) if done else np.empty(0, dtype=np.int64)
        found = np.concatenate([d[1] for d in done]) if done else owners
        order = np.argsort(owners, kind="stable")
        owners, found = owners[order], found[order]
        strange = np.flatnonzero(found < 0)
        if len(strange):  # signs without a piece become their bytes
            raw = [chr(-1 - s).encode("utf-8") for s in found[strange].tolist()]
            size = np.ones(len(found), dtype=np.int64)
            size[strange] = list(map(len, raw))
            owners, found = np.repeat(owners, size), np.repeat(found, size)
            found[found < 0] = [self.byte_id[b] for b in b"".join(raw)]
        return found.tolist(), np.cumsum(np.bincount(owners, minlength=len(words))).tolist()

    def _merge_one_by_one(self, symbols: list[int]) -> list[int]:
        """The same merges one place at a time with a heap: for long words that would take a round for each place."""
        known = self._table()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(symbols)
            if j < len(symbols) and (found := known.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        gone = [False] * len(symbols)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(symbols) or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], gone[j], after[i] = known[left, right][1], True, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [s for s, g in zip(symbols, gone) if not g]

    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = {divmod(k, self.n): (r, p) for k, r, p in zip(self.pair_key.tolist(), self.pair_rank.tolist(), self.pair_piece.tolist())}
        return self._pairs

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text without the end id."""
        return self.encode_words(self.words(text))[0]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids are silent, byte ids join to UTF-8 with U+FFFD for what is not, a first blank goes."""
        out: list[str] = []
        raw = bytearray()
        began = False
        for i in ids:
            if i in self.byte_value:
                raw.append(self.byte_value[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                began = True
            if i in self.silent:
                continue
            piece = " ⁇ " if i == self.unknown else self.plain[i]
            out.append(piece[1:] if not began and piece.startswith(" ") and i != self.unknown else piece)
            began = True
        return "".join(out) + (_utf8(bytes(raw)) if raw else "")


def _signs_with(sign: str, pieces: Iterable[str]) -> set[str]:
    """Signs linked to ``sign`` by standing beside each other in a piece: no merge crosses from them to another sign."""
    beside = {(p[k], p[k + 1]) for p in pieces for k in range(len(p) - 1) if p[k] != BLANK}
    found, size = {sign}, 0
    while len(found) > size:
        size = len(found)
        found |= {b for a, b in beside if a in found} | {a for a, b in beside if b in found}
    return found


def _utf8(data: bytes) -> str:
    """Valid UTF-8 signs as they are, every other byte as one U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at:at + size].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


class Words:
    """Ids and text of the words met so far, as strings; words not met again go when ``CACHE`` of them are known."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > CACHE:
            self.older = self.ids, self.text
            self.ids, self.text = {}, {}
        words = words.difference(self.ids)
        again = words.intersection(self.older[0])
        for w in again:
            self.ids[w], self.text[w] = self.older[0][w], self.older[1][w]
        new, model = list(words - again), self.model
        flat, ends = model.encode_words(new)
        numbers, texts, start = [model.number[i] for i in flat], [model.plain[i] for i in flat], 0
        is_byte = np.isin(flat, list(model.byte_value))
        bytes_before = np.r_[0, np.cumsum(is_byte)][np.r_[0, ends].astype(np.int64)].tolist()
        for k, (word, end) in enumerate(zip(new, ends)):
            self.ids[word] = " ".join(numbers[start:end])
            # the first blank of a text goes, so a word is decoded behind another piece
            plain = bytes_before[k] == bytes_before[k + 1]
            self.text[word] = "".join(texts[start:end]) if plain else model.decode([model.single["a"], *flat[start:end]])[1:]
            start = end


_MADE: dict[str, PieceModel] = {}
_KNOWN: dict[str, Words] = {}


def piece_model(name: str = MODEL) -> PieceModel:
    """The public model ``name``; a path with a slash is taken as it is. One per process."""
    if name not in _MADE:
        import public_tokenizers

        _MADE[name] = PieceModel(name if "/" in name else public_tokenizers.path(name))
    return _MADE[name]


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, one blank between) and decoded for every row of ``docs``.

    Ids are those of the whole text and one end id; decoded is the text of these ids. Null texts count as empty and
    have the end id alone; repeated rows come out each for itself; other columns are ignored, whatever their names; an
    empty table gives an empty result. Words are encoded once per process and kept, at most ``CACHE`` of them.
    """

    def kernel(texts: list[str]) -> dict[str, list]:
        made = piece_model(model)
        known = _KNOWN.setdefault(model, Words(made))
        cut = [made.words(t) for t in texts]
        known.learn(set().union(*cut))
        rows: dict[str, list] = {"n_tokens": [], "ids": [], "decoded": []}
        for words in cut:
            ids = " ".join([*map(known.ids.__getitem__, words), made.number[made.end]])
            whole = "".join(map(known.text.__getitem__, words))
            rows["n_tokens"].append(ids.count(" ") + 1)
            rows["ids"].append(ids)
            rows["decoded"].append(whole[1:] if whole.startswith(" ") else whole)
        return rows

    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_texts(named, kernel, "n_tokens bigint, ids string, decoded string")
