from collections import Counter

import pytest

from ledgerline.llm import packing, tokens
from ledgerline.session import scratch_path

pytest.importorskip("public_tokenizers")


def wanted(docs):
    own = packing.tokenizer()
    return Counter((r.doc_id, len(own.ids(r.text or "")) // 4) for r in docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("block_words", [7, 64, 1 << 18])
def test_round_trip_over_block_sizes(spark, odd_docs, block_words):
    path = scratch_path(spark, "tokens")
    docs = odd_docs.union(odd_docs.limit(3)).where("length(coalesce(text, '')) < 30000 or doc_id = 5")
    docs = docs.union(docs.selectExpr(*[f"-{c} - 7 AS {c}" if c == "doc_id" else c for c in docs.columns]))
    tokens.write_token_files(docs.coalesce(2), path)
    assert Counter((r.doc_id, r.n_tokens) for r in tokens.count_tokens(spark, path, block_words=block_words).collect()) == wanted(docs)


def test_files_without_ids(spark, few_docs):
    path = scratch_path(spark, "tokens")
    tokens.write_token_files(few_docs.coalesce(1), path, named=False)
    rows = tokens.count_tokens(spark, path, named=False, block_words=100).orderBy("path", "ordinal").collect()
    own = packing.tokenizer()
    assert Counter(r.n_tokens for r in rows) == Counter(len(own.ids(r.text or "")) // 4 for r in few_docs.collect())
    assert [r.ordinal for r in rows] == list(range(len(rows)))


def test_documents(spark, few_docs, odd_docs):
    assert Counter((r.doc_id, r.n_tokens) for r in tokens.document_token_counts(few_docs, scratch_path(spark, "tokens")).collect()) == wanted(few_docs)
    assert tokens.document_token_counts(odd_docs.limit(0), scratch_path(spark, "tokens")).count() == 0


def test_special_token_counts_once(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|>"), (2, "<|endoftext|>a")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.document_token_counts(docs, scratch_path(spark, "tokens")).collect()} == {1: 1, 2: 2}


def test_files_end_by_bytes(spark):
    """Ten long texts beside many short ones: no file is over its bound by more than one document."""
    docs = spark.range(400).selectExpr("id AS doc_id", "CASE WHEN id % 40 = 0 THEN repeat('long words ', 3000) WHEN id % 3 = 0 THEN NULL ELSE 'a few' END AS text")
    path = scratch_path(spark, "tokens")
    tokens.write_token_files(docs.coalesce(2), path, file_bytes=1 << 14)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").collect()
    longest = 2 * (max(n for _, n in wanted(docs)) + tokens.HEADER + 1)
    assert len(files) > 4 and max(f.length for f in files) <= (1 << 14) + longest
    assert Counter((r.doc_id, r.n_tokens) for r in tokens.count_tokens(spark, path).collect()) == wanted(docs)


def test_blocks_hold_no_file(spark, few_docs):
    path = scratch_path(spark, "tokens")
    tokens.write_token_files(few_docs.coalesce(1), path)
    whole = tokens.count_tokens(spark, path, block_words=1 << 18)
    small = tokens.count_tokens(spark, path, block_words=9)
    assert Counter(whole.collect()) == Counter(small.collect())
