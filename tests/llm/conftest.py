import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like the operators' own."""
    clean = "the quick brown fox jumps over the lazy dog and runs home to sleep well before the long cold winter comes again"
    rows = [
        (1, clean, "en", "a"), (2, clean + " now", "en", "a"), (2, clean + " now", "en", "a"), (3, "", "en", "b"), (3, None, None, None),
        (None, "call her on +1 (375) 555-4393 or a.b@c.org", "en", "b"), (None, None, None, None), (4, "word " * 30_000, "en", "b"), (5, "x" * 20_000, "fr", "c"),
        (6, "you idiot 4111111111111111 at 10.0.0.255", "en", "c"), (7, " \n\t ", "de", "c"),
    ]
    names = ["n_words", "fp", "score", "key", "block", "rank", "component_id", "text_hash", "k1", "k2", "slot", "weight", "phrase", "host", "word", "base", "n_hits", "predicted",
             "_row", "_hash", "hash", "row", "_h", "_id", "_text", "_old", "_spans", "spans", "place", "_file"]
    data = [(i, t, lang, s, len(t or ""), *["clash"] * len(names)) for i, t, lang, s in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def few_docs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
