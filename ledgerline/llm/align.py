"""Alignment of two tokenizers' ids by their byte offsets.

Every text is encoded twice. The running ends of the tokens of each side are the keys of a dictionary from end to token
index; the keys both dictionaries have, found by intersecting them as sets and sorted, cut both id lists into groups
that span the same bytes. The tokens that close a group end together and are linked; the pairs within a group are
expanded per slice as well. Both tokenizers always cut before a blank or line break behind a sign, behind a single line
break, and between a Latin letter and a stop, so texts are taken apart there and each distinct part is aligned once and
kept.

Two tokens that end together share a suffix: one's bytes end with the other's. A token has no more suffixes than bytes,
so the distinct pairs number at most the bytes of all entries of both vocabularies (times two for entries with equal
bytes), whatever the corpus. Their corpus counts are therefore sent to all tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, slices, text_or_empty

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
SHIFT = 1 << 16
CACHE = 500_000


LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
STOPS = ".,;:!?"


class Aligner:
    """Groups and links of the parts of texts; each part has a number while it is kept."""

    def __init__(self, first: str, second: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(first, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # the byte-level alphabet: printable Latin-1 signs stand for themselves, the others follow from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        entries = sorted((i, t) for t, i in model["vocab"].items() if set(t) <= set(sign))[:256 + len(merges)]
        if [t for _, t in entries[256:]] != merges or [i for i, _ in entries] != list(range(len(entries))):
            raise ValueError("needs a byte-level model whose ids follow its merges")
        self.first_bytes = [bytes(sign[c] for c in t) for _, t in entries]
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.first_bytes)},
                                       special_tokens={}).encode_ordinary
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        if max(len(entries), self.second.get_piece_size()) > SHIFT:
            raise ValueError(f"ids must be below {SHIFT}")
        read = self.second
        self.second_bytes = [bytes([int(p[3:5], 16)]) if read.is_byte(i) else p.replace("▁", " ").encode()
                             for i, p in ((i, read.id_to_piece(i)) for i in range(read.get_piece_size()))]
        if any(re.search(f"[{LETTERS}][{STOPS}]|.[\n]|[\n].|[^▁]▁", read.id_to_piece(i), re.S) for i in range(read.get_piece_size())):
            raise ValueError("texts can't be cut for this model")
        self.first_size, self.second_size = (list(map(len, x)) for x in (self.first_bytes, self.second_bytes))
        self.name = list(map(str, range(SHIFT)))
        self.parts_of = re.compile(
            rf" ?[{LETTERS}]+(?=[ \n{STOPS}]|\Z)|[{STOPS}]+(?=[ \n]|\Z)|\n(?=\S)|\s*\S+(?:[^\S \n]\s*\S*)*|\s+").findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        # by part: tokens of either side, pairs within groups, links, and 1 if the tokens do not spell the part
        self.sizes = np.empty((0, 5), dtype=np.int64)
        self.links = np.empty(0, dtype="<u4")
        self.first_link = np.empty(0, dtype=np.int64)

    def learn(self, parts: set[str]) -> None:
        if len(self.number) > CACHE:
            self.forget()
        new = list(parts.difference(self.number))
        first = [self.first(p) for p in new]
        # the second tokenizer puts a blank in front; behind a line break a part is encoded as it is
        second = [ids[2:] for ids in self.second.encode(["\n" + p for p in new], num_threads=1)]
        sizes, links = [], []
        for part, a, b in zip(new, first, second):
            self.number[part] = len(self.number)
            groups, linked, size = self.align(part, a, b)
            self.groups.append(groups)
            links.append(linked)
            sizes.append(size)
        if new:
            self.sizes = np.concatenate([self.sizes, np.array(sizes, dtype=np.int64)])
            self.links = np.concatenate([self.links, np.fromiter(chain.from_iterable(links), dtype="<u4")])
            self.first_link = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]

    def align(self, part: str, a: list[int], b: list[int]) -> tuple[str, list[int], tuple[int, ...]]:
        data = part.encode("utf-8")
        if b"".join(map(self.first_bytes.__getitem__, a)) != data or b"".join(map(self.second_bytes.__getitem__, b)) != data:
            return "", [], (0, 0, 0, 0, 1)
        end_a = dict(zip(accumulate(map(self.first_size.__getitem__, a)), count(1)))
        end_b = dict(zip(accumulate(map(self.second_size.__getitem__, b)), count(1)))
        name_a, name_b = list(map(self.name.__getitem__, a)), list(map(self.name.__getitem__, b))
        groups, links, pairs, from_a, from_b = [], [], 0, 0, 0
        for end in sorted(end_a.keys() & end_b.keys()):
            to_a, to_b = end_a[end], end_b[end]
            groups.append(",".join(name_a[from_a:to_a]) + "|" + ",".join(name_b[from_b:to_b]))
            links.append(a[to_a - 1] * SHIFT + b[to_b - 1])
            pairs += (to_a - from_a) * (to_b - from_b)
            from_a, from_b = to_a, to_b
        return ";".join(groups), links, (len(a), len(b), pairs, len(links), 0)

    def parts(self, text: str) -> list[str]:
        """A blank and the text, cut where both tokenizers always cut; an empty text has no part."""
        return self.parts_of(" " + text) if text else []

    def linked(self, numbers: np.ndarray) -> np.ndarray:
        """Links of the numbered parts, one behind another."""
        size = self.sizes[numbers, 3]
        shift = np.repeat(self.first_link[numbers] - (np.cumsum(size) - size), size)
        return self.links[np.arange(len(shift)) + shift]


_MADE: dict[tuple[str, str], Aligner] = {}


def aligner(first: str = FIRST, second: str = SECOND) -> Aligner:
    """The pair of public tokenizers; paths with a slash are taken as they are. One per process."""
    if (first, second) not in _MADE:
        import public_tokenizers

        _MADE[first, second] = Aligner(*(n if "/" in n else public_tokenizers.path(n) for n in (first, second)))
    return _MADE[first, second]


def groups_of(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_pairs, groups and links for every row of ``docs``.

    groups is ``a1,a2|b1;a3|b2,b3``; n_pairs is the number of token pairs that stand in the same group; links holds
    the pairs of tokens that end together as little-endian 32-bit numbers, the first id in the upper half. Texts that
    are null or empty, or whose tokens do not spell a blank and the text, have no tokens.
    """

    def kernel(texts: list[str]) -> dict[str, list]:
        made = aligner(first, second)
        cut = [made.parts(t) for t in texts]
        made.learn(set().union(*cut))
        rows: dict[str, list] = {n: [] for n in ("n_a", "n_b", "n_pairs", "n_groups", "groups", "links")}
        for parts in cut:
            numbers = list(map(made.number.__getitem__, parts))
            sizes = made.sizes[numbers].sum(axis=0)
            if sizes[4]:
                numbers, sizes = [], 0 * sizes
            values = *sizes[:4].tolist(), ";".join([made.groups[k] for k in numbers]), made.linked(np.array(numbers, dtype=np.int64)).tobytes()
            for column, value in zip(rows.values(), values):
                column.append(value)
        return rows

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return map_texts(named, kernel, "n_a bigint, n_b bigint, n_groups bigint, n_pairs bigint, groups string, links binary")


def pair_counts(grouped: DataFrame) -> DataFrame:
    """pair, n: in how many links of the whole table a pair of ids stands; counted within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        for batch in slices(batches):
            found, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4"), return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, found]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    return grouped.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND, groups: Column | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups and n_pairs for every row of ``docs``.

    n_links counts the token pairs that end together, count_sum adds the corpus counts of their id pairs, n_best counts
    those whose count is the highest of their second id. Null and empty texts have zeros and ''. Repeated rows count
    each for itself, null ids stay, other columns are ignored whatever their names, an empty table gives no rows.
    ``groups`` is an expression over that column, such as its digest, to be kept in its place.
    """
    made = groups_of(docs, first, second)
    grouped = materialise(made if groups is None else made.withColumn("groups", groups), "align-groups")
    # bounded by the two vocabularies, see above
    counted = pair_counts(grouped).toArrow()
    pairs, counts = counted.column("pair").to_numpy(), counted.column("n").to_numpy()
    order = np.argsort(pairs)
    pairs, counts = pairs[order].astype("<u4"), counts[order]
    highest = np.zeros(SHIFT, dtype=np.int64)
    np.maximum.at(highest, pairs % SHIFT, counts)
    table = docs.sparkSession.sparkContext.broadcast((pairs, counts, counts == highest[pairs % SHIFT]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in slices(batches):
            links = batch.column(batch.schema.get_field_index("links")).to_pylist()
            size = np.array([len(x) // 4 for x in links], dtype=np.int64)
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), dtype="<u4"))
            before = np.r_[0, np.cumsum(size)]
            totals = [np.diff(np.r_[0, np.cumsum(c[at])][before]) for c in (best.astype(np.int64), counts)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in KEPT]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (size, *totals))], names=[*KEPT, "n_links", "n_best", "count_sum"])

    return grouped.select(*KEPT, "links").mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_pairs bigint, groups string, n_links bigint, n_best bigint, count_sum bigint")


KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_pairs", "groups"]
