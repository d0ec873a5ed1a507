import math
import random
import zlib

import pytest

from ledgerline.llm import toxicity


def test_fold_undoes_look_alikes_and_digits():
    assert toxicity.fold("You ІDIOT, m0r0n; 1d10t 2024!") == " you idiot moron idiot 2024 "


def test_exceptions_and_length():
    m = toxicity.Matcher({" trash": 5.0})
    hit, n = m.score("this is trash")
    assert hit > 0.5 and n == 1
    assert m.score("into the trash can") == (m.score("")[0], 0)
    assert m.score("trash " + "word " * 50_000)[0] < hit


def test_learns_words_and_stems_and_ranks_held_out_documents(spark):
    filler = ["alpha beta gamma delta", "one two three four", "red green blue black"]
    docs = [(i, f"{filler[i % 3]} {['grobian', 'wretchling', 'wretchery'][i % 3] if i % 2 else 'friend'} {i}") for i in range(400)]
    labels = [(i, i % 2) for i, _ in docs]
    out = toxicity.toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == r.doc_id % 2 == (r.score >= 0.5) for r in out)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {'bad' if i % 2 else 'good'}word {i}") for i in range(200)], "doc_id bigint, text string")
    def scores(flip):
        labels = [(i, 1 - i % 2 if flip and zlib.crc32(str(i).encode()) % 5 == 0 else i % 2) for i in range(200)]
        return {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert scores(False) == scores(True)


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, None), (None, 1)], "doc_id bigint, toxic int")
    out = toxicity.toxicity(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert [r.predicted for r in out if r.doc_id == 6] == [1] and sum(r.predicted for r in out) == 1
    assert toxicity.toxicity(odd_docs.limit(0), labels.limit(0)).count() == 0


def _by_hand(lexicon, exceptions, text):
    """Every place of the folded text against every entry and phrase."""
    folded, total, hits = toxicity.fold(text), 0.0, 0
    inside = [(at, at + len(p) + 1) for p in exceptions for at in range(len(folded)) if folded.startswith(f" {p} ", at)]
    for at in range(len(folded)):
        weights = [w for e, w in lexicon.items() if folded.startswith(e, at)]
        if weights and not any(a <= at < b for a, b in inside):
            total, hits = total + max(weights), hits + 1
    x = total / (1.0 + (folded.count(" ") - 1) / 5_000.0) ** 0.25
    return 1.0 / (1.0 + math.exp(-(x - 1.5))), hits


@pytest.mark.parametrize("seed", range(8))
def test_matcher_against_every_place(seed):
    rng = random.Random(seed)
    words = ["trash", "can", "tr4sh", "sore", "loser", "l0ser", "losers", "idiot", "1d10t", "no", "class", "clown", "clowns", "word", "2024", "x", "іdiot"]
    lexicon = {" trash ": 1.0, " trash": 0.7, " loser ": 2.0, " lose": 1.5, " clown": 0.4, " idiot ": 5.0, " class clown ": 3.0}
    m = toxicity.Matcher(lexicon)
    for _ in range(60):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 25)))
        score, hits = m.score(text)
        wanted, n = _by_hand(lexicon, toxicity.EXCEPTIONS, text)
        assert hits == n and math.isclose(score, wanted, rel_tol=1e-12), text


def test_long_mixed_tokens_are_unfolded():
    assert toxicity.fold("1d10t" + "s" * 60) == " idiot" + "s" * 60 + " "
    assert toxicity.Matcher({" idiot": 5.0}).score("1d10t" + "s" * 60)[1] == 1
