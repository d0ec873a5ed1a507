"""Rows that only a short hash would take for one another stay apart."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import embeddings, lm, repeats


def colliding(spark, words, *hashed):
    """Two texts whose 32-bit hashes are equal."""
    body = F.concat(F.lit(words), F.col("id").cast("string"))
    rows = spark.range(400_000).select(body.alias("text")).withColumn("h", F.hash(*hashed, "text"))
    pair = rows.groupBy("h").agg(F.collect_list("text").alias("texts")).where(F.size("texts") == 2).orderBy("h").first()
    return list(pair["texts"])


def test_repeats_leave_the_other_text_alone(spark):
    a, b = colliding(spark, "unlike any other word of this text " * 9, F.lit(True))
    docs = spark.createDataFrame([(None, a), (None, b[:-1] + "x"), (None, b), (7, a[:300] + " and then its own end")], "doc_id bigint, text string")
    wanted = Counter()
    texts = [r.text.encode() for r in docs.collect()]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        wanted[len(t), sum(any(seen[t[i:i + 200]] > 1 for i in range(max(0, k - 199), min(k, len(t) - 200) + 1)) for k in range(len(t)))] += 1
    assert Counter((r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs).collect()) == wanted


def test_scores_of_documents_without_id(spark):
    a, b = colliding(spark, "x ")
    docs = spark.createDataFrame([(None, a), (None, b), (None, "one two three"), (1, a)], "doc_id bigint, text string")
    rows = lm.language_scores(docs).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 3), (True, 3), (True, 3), (True, 4)]
    assert len({round(r.score, 9) for r in rows if r.doc_id is None}) >= 2


def test_vectors_of_labels_with_equal_hash(spark):
    names = spark.range(400_000).select(F.concat(F.lit("lab"), "id").alias("label")).withColumn("h", F.hash("label"))
    one, other = names.groupBy("h").agg(F.collect_list("label").alias("l")).where(F.size("l") == 2).orderBy("h").first()["l"]
    vectors = spark.createDataFrame([(1, one, [1.0, 2.0, 3.0]), (2, other, [1.0, 2.0, 3.0]), (3, one, [1.0, 2.0, 3.01])], "vec_id bigint, label string, embedding array<double>")
    rows = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(vectors).collect()}
    assert rows == {1: (1, 1), 2: (0, 2), 3: (1, 1)}


@pytest.mark.parametrize("text", ["", None])
def test_empty_texts_without_id(spark, text):
    docs = spark.createDataFrame([(None, text), (None, text), (2, "a")], "doc_id bigint, text string")
    assert sorted(r.n_tokens for r in lm.language_scores(docs).collect()) == [1, 1, 2]
