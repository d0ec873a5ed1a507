import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pieces, queries

sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

TEXTS = [
    "", " ", "  ", "   x   ", "\n", "a\n\nb", "\t", "a\r\nb", "a  b", "▁", "a▁b", "▁▁ ▁", "</s> <s> <unk> <0x41>", "é é", "日本語 한국어", "😀😀 a\U0010ffff",
    "\x00a\x00", "﻿x", "�", "퟿", "x" * 3_000, " " * 3_000, "ab" * 2_000, "word " * 3_000, "aaaa" + " " * 37 + "b", "-" * 999, "=" * 33 + "\n" * 40, "ﬁ Å  　",
]


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=public.path(pieces.MODEL))


def test_ids_and_text_equal_the_library(reference, few_docs):
    own = pieces.piece_model()
    for text in TEXTS + [r.text or "" for r in few_docs.collect()]:
        ids = reference.encode(text)
        assert own.encode(text) == ids, text[:60]
        assert own.decode(ids) == reference.decode(ids), text[:60]


def test_random_strings(reference):
    own, rng = pieces.piece_model(), random.Random(7)
    alphabets = ["abcdeinorst ", "ab", " \n\ta", "éèàçñ aeiou", "0123456789.,- ", "日本語中文字 a", "".join(map(chr, range(32, 0x250)))]
    for _ in range(3_000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 120)))
        assert own.encode(text) == reference.encode(text), text
    # pieces glued together hit the pairs that rank above the symbols they are made of
    for _ in range(2_000):
        text = "".join(own.plain[rng.randrange(259, own.n)] for _ in range(rng.randint(1, 12)))
        assert own.encode(text) == reference.encode(text), text


def test_any_ids_are_decoded(reference):
    own, rng = pieces.piece_model(), random.Random(8)
    for _ in range(3_000):
        ids = [rng.choice([rng.randrange(own.n), rng.randrange(3, 259), rng.randrange(0, 3)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == reference.decode(ids), ids


def test_heap_equals_rounds(reference):
    own = pieces.piece_model()
    assert not own.safe.all()
    for text in (" " * 5_000, " " * 700 + "the", "the" * 900):
        assert own.encode(text) == reference.encode(text)


def test_query(spark, few_docs, odd_docs, reference, tmp_path):
    for i, docs in enumerate((few_docs, odd_docs, odd_docs.limit(0))):
        docs.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        rows = queries.QUERIES["op13_sentencepiece"](spark, f"{tmp_path}/{i}")
        assert rows.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

        def expect(text):
            ids = reference.encode(text or "", add_eos=True)
            return len(ids), *[hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), reference.decode(ids))]

        wanted = sorted((str(r.doc_id), *expect(r.text)) for r in docs.collect())
        assert sorted((str(r[0]), *r[1:4]) for r in rows.collect()) == wanted


def test_operator_keeps_the_real_outputs(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pieces.encode_decode(docs).collect()}
    assert rows[1].decoded == "a b" and rows[2].decoded == "" and rows[2].ids == "2"
    assert pieces.encode_decode(docs).agg(F.sum("n_tokens")).first()[0] == 4
