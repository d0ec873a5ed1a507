import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["a  b", "a\n b", " a", "a ", "", "a\n\nb", "don't it's  x", "<|endoftext|> hi", "é b c", "a \nb", "日本 語", "x" * 500, "1 22 333", "\n", "a\r\nb", "it 's 'll we'll 've", "a\xa0b c", "a b"]


def test_ids_equal_the_tokenizer(reference, few_docs):
    own = packing.tokenizer()
    for text in TEXTS + [r.text for r in few_docs.limit(60).collect()]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, text[:50]


def test_best_multiset_fills_the_window():
    counts = np.zeros(1024, dtype=np.int64)
    counts[[700, 300, 200, 24, 100]] = [1, 1, 3, 1, 5]
    pattern = packing.best_multiset(counts, 1024)
    assert sum(k * n for k, n in pattern.items()) == 1024 and 700 in pattern
    assert all(counts[k] >= n for k, n in pattern.items())


def test_plan_uses_every_remainder_once():
    rng = np.random.default_rng(1)
    counts = {k: int(n) for k, n in zip(range(1, 1024), rng.integers(400, 600, 1023))}
    used, sequences = defaultdict(int), 0
    for pattern, times in packing.plan_remainders(counts):
        assert sum(k * n for k, n in pattern.items()) <= 1024
        sequences += times
        for k, n in pattern.items():
            used[k] += n * times
    assert used == counts
    assert sequences * 1024 < 1.002 * sum(k * n for k, n in counts.items()) + 1024 * 3


def check(docs):
    own = packing.tokenizer()
    rows = packing.pack(docs).collect()
    texts = [(r.doc_id, own.ids(r.text or "") + b"\0\0\0\0") for r in docs.select("doc_id", "text").collect()]
    assert sum(r.length for r in rows) == sum(len(ids) // 4 for _, ids in texts)
    sums = defaultdict(int)
    for doc_id, ids in texts:
        for start in range(0, len(ids) // 4, 1024):
            sums[doc_id, start, min(1024, len(ids) // 4 - start), zlib.crc32(ids[4 * start:4 * (start + 1024)]), len(ids) // 4] += 1
    found, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        found[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found == sums
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences), sum(len(ids) // 4 for _, ids in texts)


def test_pack(few_docs):
    sequences, tokens = check(few_docs)
    assert sequences <= 1.05 * tokens / 1024 + 2


def test_odd_rows(odd_docs):
    check(odd_docs)
    assert packing.pack(odd_docs.limit(0)).count() == 0


def test_ids_equal_the_tokenizer_as_loaded(spark, few_docs):
    loaded, own = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.tokenizer()
    literal = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x\n", "<|endoftext", "a<|endoftext|>\n b  c"]
    for text in TEXTS + literal + [r.text for r in few_docs.limit(20).collect()]:
        assert np.frombuffer(own.text_ids(text), "<u4").tolist() == loaded.encode(text, add_special_tokens=False).ids, text[:50]
    rows = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(literal)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(literal):
        ids = np.array(loaded.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (rows[i].doc_tokens, rows[i].ids_crc32) == (len(ids) // 4, zlib.crc32(ids))
