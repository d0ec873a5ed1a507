import os

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from ledgerline.llm import packing, pii, simhash, toxicity
from ledgerline.llm.common import materialise

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_stages(spark):
    docs = before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER), f"test-{name}")
        kept[name] = docs
        if name != "pack":
            assert docs.columns == before.columns
    texts = {r.doc_id: r.text for r in before.collect()}
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(before, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    clean = {r.doc_id for r in kept["toxicity"].collect()}
    assert clean == {i for i, p in scores.items() if not p}
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(kept["toxicity"]).collect()}
    single = {r.doc_id for r in kept["near_copies"].collect()}
    assert single == set(groups.values())
    private = {r.doc_id: r for r in kept["private"].collect()}
    spans = {r.doc_id: r.spans for r in pii.find(kept["near_copies"]).collect()}
    assert set(private) == single
    for i, r in private.items():
        assert (r.text == texts[i]) == (not spans[i]) and r.n_chars == len(r.text)
    assert {r.doc_id: r.text for r in kept["mix"].collect()} == {i: r.text for i, r in private.items()}
    own = packing.tokenizer()
    tokens = {r.doc_id: r.doc_tokens for r in kept["pack"].collect()}
    assert tokens == {i: len(own.ids(r.text)) // 4 + 1 for i, r in private.items()}


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, FOLDER), f"odd-{name}")
        if name == "pack":
            continue
        assert docs.columns == before.columns
        own = {"doc_id", "text", "lang", "source", "n_chars"}
        rows = docs.collect()
        assert rows and all(r[c] == "clash" for r in rows for c in docs.columns if c not in own)
        assert {(r.doc_id, r.lang, r.source) for r in rows} <= {(r.doc_id, r.lang, r.source) for r in before.collect()}
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect()]
    assert {None, 1, 3, 4, 5} <= set(ids)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, materialise(odd_docs.limit(0), "none"), FOLDER).count() == 0, name


def test_queries_are_registered():
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {"op9_mixing", "op10_host_quality", "op12_ranked_search"} <= set(oracle_sql())


def test_sequences_follow_the_mixture(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(250)), "en", "src0" if i % 4 == 0 else "src3", 1) for i in range(400)]
    docs = materialise(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "test-unmixed")

    def share(stage):
        mixed = materialise(stage(spark, docs, FOLDER), "test-mixed")
        pieces = corpus_pipeline.pack_windows(spark, mixed, FOLDER).collect()
        assert {p.doc_id for p in pieces} == set(range(400))
        last = max(p.sequence_id for p in pieces)
        assert {p.sequence_id for p in pieces} == set(range(last + 1))
        early = [p for p in pieces if p.sequence_id < last / 5 and p.start == 0]
        return sum(p.doc_id % 4 == 0 for p in early) / len(early)

    assert share(corpus_pipeline.mix_sources) > 0.6
    assert share(lambda spark, docs, folder: docs) < 0.4
