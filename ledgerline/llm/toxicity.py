"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters of other scripts, digits put for letters), one Aho-Corasick automaton
finds lexicon entries and exception phrases in one pass, hits inside an exception are dropped, and the summed
weights are normalised by length and squashed to 0 .. 1.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, text_or_empty

# Letters of other scripts that look like Latin ones, and signs put for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# Phrases in which an otherwise listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser", "not stupid", "no idiot")
# Lexicon entries known before any label is seen, each with the weight of a sure hit.
SEEDS = ("idiot", "moron", "stupid", "scum")

PREFIXES = range(4, 9)
TRAIN_ROWS = 20_000
_WORD = re.compile(r"[^\W_]+")
_SWAP = re.compile(r"(?:[^\W\d_]+[0-9@$]+|[0-9@$]+[^\W\d_]+)[^\W_@$]*(?:[@$0-9]*[^\W_@$]*)*")


@lru_cache(maxsize=1)
def _tables() -> tuple[dict, dict]:
    wide = {}
    for code in range(0xFF01, 0xFF5F):  # full-width forms
        wide[code] = unicodedata.normalize("NFKC", chr(code)).lower()
    return {**wide, **{ord(k): v for k, v in LOOK_ALIKES.items()}}, {ord(k): v for k, v in DIGITS.items()}


def fold(text: str) -> str:
    """Lower case, words apart by single blanks with one at either end, look-alikes and swapped digits undone."""
    look, digits = _tables()
    low = text.lower()
    if not low.isascii():
        low = low.translate(look)
    # signs stand for letters only next to letters; plain numbers stay as they are
    low = _SWAP.sub(lambda m: m[0].translate(digits), low)
    return " " + " ".join(_WORD.findall(low)) + " "


def _features(text: str) -> set[str]:
    found: set[str] = set()
    for word in set(fold(text).split()):
        if len(word) < 3:
            continue
        found.add(f" {word} ")
        for n in PREFIXES:
            if len(word) >= n:
                found.add(" " + word[:n])
    return found


def learn_lexicon(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, min_docs: int = 8, precision: float = 0.8) -> dict[str, float]:
    """Entry -> weight from labelled texts (doc_id, text) and (doc_id, toxic).

    Fits on the texts of at most ``train_rows`` labels, those with the smallest hash that are not held out. An entry is a whole word or the
    beginning of one, of 4 to 8 letters; its weight is the log of how much more often documents marked toxic hold
    it than others. Candidates have ``min_docs`` marked documents and at least ``precision`` of their documents
    marked; as they stand in the sample, ``train_rows`` bounds them. Of these, entries are taken one by one, each
    time the one that explains most marked documents not yet explained, so the other words of much copied toxic
    documents stay out. Repeated labels of a document count as toxic if any is.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))  # two numbers a row
    sample = docs.select("doc_id", text_or_empty("text").alias("text")).join(chosen, "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, plain, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (marked if toxic else plain).update(_features(text))
                n[1 if toxic else 0] += 1
        keys = list(marked.keys() | plain.keys())
        if n[0] or n[1]:
            yield pa.RecordBatch.from_pydict({
                "entry": pa.array([*keys, ""], pa.string()), "marked": pa.array([*[marked[k] for k in keys], n[1]], pa.int64()),
                "plain": pa.array([*[plain[k] for k in keys], n[0]], pa.int64())})

    counts = materialise(
        sample.mapInArrow(count, "entry string, marked bigint, plain bigint").groupBy("entry")
        .agg(F.sum("marked").alias("marked"), F.sum("plain").alias("plain")).where((F.col("marked") >= min_docs) | (F.col("entry") == "")), "lexicon")
    totals = counts.where("entry = ''").first()
    lexicon = {f" {word} ": 5.0 for word in SEEDS}
    if totals is None:
        return lexicon
    rate = ((F.col("marked") + 0.5) / (totals["marked"] + 1.0)) / ((F.col("plain") + 0.5) / (totals["plain"] + 1.0))
    likely = (F.col("entry") != "") & (F.col("marked") >= precision * (F.col("marked") + F.col("plain")))
    best = counts.where(likely).withColumn("weight", F.log(rate)).where("weight > 0").orderBy(F.desc("weight"), "entry")
    rows = best.collect()
    weights = {row["entry"]: row["weight"] for row in rows}
    plain = {row["entry"]: row["plain"] for row in rows}
    sure = {row["entry"] for row in rows if row["plain"] == 0 and row["marked"] >= 5 * min_docs}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"entries": pa.array([
                np.array([number[f] for f in _features(t) if f in number], dtype=np.int32).tobytes() for t in batch.column(0).to_pylist()])})

    # at most train_rows rows, each with the numbers of its candidates
    names, number = list(weights), {entry: i for i, entry in enumerate(weights)}
    left = [np.frombuffer(row["entries"], dtype=np.int32) for row in sample.where("toxic = 1").select("text").mapInArrow(held, "entries binary").collect()]
    while left:
        counted = np.bincount(np.concatenate(left), minlength=len(names))
        gain = {names[i]: int(counted[i]) for i in np.flatnonzero(counted)}
        if not gain:
            break
        entry, new = max(gain.items(), key=lambda x: (x[1] - 2 * plain[x[0]], not x[0].endswith(" "), len(x[0]), x[0]))
        if new - 2 * plain[entry] < max(3, min_docs // 2) and entry not in sure:
            break
        lexicon[entry] = max(weights[entry], 3.0)
        left = [entries for entries in left if number[entry] not in entries]
    return lexicon


class Matcher:
    """Lexicon and exceptions in one automaton."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def score(self, text: str) -> tuple[float, int]:
        """Score 0 .. 1 and number of hits."""
        folded = fold(text)
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                harmless.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        hits = [w for start, w in best.items() if not any(a <= start < b for a, b in harmless)]
        total = sum(hits)
        words = folded.count(" ") - 1
        x = total / (1.0 + max(words, 0) / 5_000.0) ** 0.25
        return 1.0 / (1.0 + math.exp(-(x - 1.5))), len(hits)


def score_texts(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """``docs`` with its text replaced by ``score`` and ``n_hits``, which take the place of columns named so.

    The lexicon is bounded by the sample of its fit. A null or empty text has no hits and the lowest score;
    repeated rows stay; an empty table stays empty.
    """
    made: list[Matcher] = []

    def kernel(texts: list[str]) -> dict[str, list]:
        if not made:
            made.append(Matcher(lexicon, exceptions))
        rows = [made[0].score(t) for t in texts]
        return {"score": [r[0] for r in rows], "n_hits": [r[1] for r in rows]}

    kept = docs.drop("score", "n_hits").withColumn("text", text_or_empty("text"))
    return map_texts(kept, kernel, "score double, n_hits bigint")


def held_out() -> Column:
    """Documents that never serve for learning: crc32 of the id's text has remainder 0 by 5; null ids do not count."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits for every row of ``docs``.

    Learns from labelled rows that are not held out. Without usable labels only the seed entries count. Null and
    empty texts score lowest; repeated rows score alike; other columns are ignored; no rows give no rows.
    """
    lexicon = learn_lexicon(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), train_rows)
    scored = score_texts(docs.select("doc_id", held_out().alias("held_out"), F.col("text")), lexicon)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
