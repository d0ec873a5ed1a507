import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import lm


@pytest.mark.parametrize("universe,n", [(1000, 50), (10, 300), (1 << 40, 1000), (5, 5), (1, 1), (64, 64)])
def test_elias_fano(universe, n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n))
    coded = lm.EliasFano(values)
    asked = np.r_[rng.integers(0, universe + 3, 200), values]
    assert (coded.get(np.arange(n)) == values).all() and (coded.successor(asked) == np.searchsorted(values, asked)).all()


def tokens_of(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [""]


def check(docs, **params):
    rows = lm.language_scores(docs, **params).collect()
    texts = docs.select("doc_id", "text").collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in texts if not out(r.doc_id) for w in tokens_of(r.text))
    n, v = sum(counts.values()), len(counts)
    wanted = Counter()
    for r in texts:
        words = tokens_of(r.text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        wanted[r.doc_id, out(r.doc_id), len(words), sum(counts[w] > 0 for w in words), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4) + 0.0) for r in rows) == wanted
    return rows


def test_base_equals_brute_force_and_the_model_predicts_better(few_docs):
    rows = [r for r in check(few_docs) if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_words_take_the_join(few_docs):
    a = {r.doc_id: r for r in check(few_docs, word_share=1e-2, gram_word_share=2e-2)}
    b = {r.doc_id: r for r in check(few_docs, gram_word_share=2e-2)}
    assert all(math.isclose(a[i].score, b[i].score, rel_tol=1e-9) for i in a)


def test_the_model_is_a_distribution(spark):
    docs = spark.createDataFrame([("a b a b c a b",), ("a b c c",), ("b a b c",)], "text string")
    model, counts = lm.train(docs, gram_word_share=1e-3)
    model.open()
    known = [bytes(r.word) for r in counts.collect()]
    assert len(model.number) == len(known) == 4
    end = model.number[b""]
    for context in ([end], [end, model.number[b"a"]], [end, model.number[b"a"], model.number[b"b"]], [end, model.number[b"c"], -1]):
        total = 0.0
        for word in [*model.number.values(), -1]:
            ids = np.array([*context, word])
            lead = np.zeros(len(ids), dtype=bool)
            lead[0] = True
            a, b = model.probability(ids, lead)
            total += a[-1] + b[-1] * (model.uni[word] if word >= 0 else 1 / (model.tokens + model.distinct + 1))
        assert 0.9 < total <= 1 + 1e-6


def test_odd_rows(odd_docs):
    check(odd_docs)
    assert lm.language_scores(odd_docs.limit(0)).count() == 0


def naive_scores(texts, discount=lm.DISCOUNT):
    """Per (text, learnt): the score by plain counting of all words, pairs and triples."""
    grams, followers = Counter(), Counter()
    streams = [["", *tokens_of(t)] for t, _ in texts]
    for s, (_, learnt) in zip(streams, texts):
        if learnt:
            grams.update((w,) for w in s[1:])
            grams.update(zip(s, s[1:]))
            grams.update(zip(s, s[1:], s[2:]))
    for g in grams:
        followers[g[:-1]] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def coded(p):
        return 10.0 ** (-math.ceil(-math.log10(p) * lm.STEPS - 1e-9) / lm.STEPS)

    def probability(gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (n + v + 1)
        context = gram[:-1]
        if not followers[context]:
            return probability(gram[1:])
        held = coded((grams[gram] - discount) / grams[context]) if gram in grams else 0.0
        return held + coded(discount * followers[context] / grams[context]) * probability(gram[1:])

    return [sum(math.log10(probability(tuple(s[max(0, i - 2):i + 1]))) for i in range(1, len(s))) for s in streams]


@pytest.mark.parametrize("params", [{}, {"shard": 4000}, {"shard": 400, "word_share": 1e-3, "gram_share": 1e-3}, {"shard": 4000, "word_share": 0.5, "gram_word_share": 1e-3}])
def test_all_ngrams_are_in_the_model_wherever_they_are_looked_up(spark, params):
    rng = np.random.default_rng(7)
    names = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(names, size, p=share / share.sum())) for size in rng.integers(0, 60, 120)]
    texts += ["seen once only here", "w0 w1 seen once only", texts[0], "w0 w0 unknown w1 w0 unknown"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    wanted = naive_scores([(t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in enumerate(texts)])
    found = {r.doc_id: r.score for r in lm.language_scores(docs, **params).collect()}
    assert [round(found[i], 6) for i in range(len(texts))] == [round(s, 6) for s in wanted]


def test_a_rare_phrase_keeps_its_score_in_a_larger_corpus(spark):
    rng = np.random.default_rng(3)
    phrase = "zeta eta theta iota"
    few = [(1, phrase), (2, phrase), (3, "alpha beta")]
    filler = [(i, " ".join(f"f{x}" for x in rng.integers(0, 50, 1000))) for i in range(4, 204)]
    gain = []
    for rows in (few, few + filler):
        r = {r.doc_id: r for r in lm.language_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), shard=20_000, gram_share=1e-3).collect()}[1]
        gain.append((r.score - r.base_score) / r.n_tokens)
    assert gain[1] > gain[0] > 0 and r.score > -8
