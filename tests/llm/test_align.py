import hashlib
import random
from collections import Counter

import pytest

from ledgerline.llm import align, queries

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

TEXTS = [
    "", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n", "\ta\t b\t", "a▁b", "▁", "<|endoftext|> x </s><s>", "é日本 語 한국어 é", "😀 😀😀", "x" * 700, " " * 90,
    "a\xa0 b　c", "\x1c a\x1cb", "don't we'll 's", "12 345 6.7", "\x00 a", "foo  \n  bar  ",
]


@pytest.fixture(scope="module")
def both():
    first = tokenizers.Tokenizer.from_file(public.path(align.FIRST))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public.path(align.SECOND)), align.aligner()


def tokens_of(text, both):
    """Ids and ends of both sides over the whole text at once."""
    first, second, made = both
    whole = (" " + text).encode()
    sides = []
    for ids, spelt in ((first.encode(" " + text, add_special_tokens=False).ids, made.first_bytes), (second.encode(text), made.second_bytes)):
        at, ends = 0, []
        for i in ids:
            at += len(spelt[i])
            ends.append(at)
        if not text or b"".join(spelt[i] for i in ids) != whole:
            return ([], []), ([], [])
        sides.append((ids, ends))
    return sides


def brute(texts, both):
    sides = [tokens_of(t or "", both) for t in texts]
    links = [[(i, j) for i, e in zip(*a) for j, f in zip(*b) if e == f] if len(a[0]) < 300 else
             [(i, by_end[e]) for by_end in [dict(zip(b[1], b[0]))] for i, e in zip(*a) if e in by_end] for a, b in sides]
    count = Counter(p for x in links for p in x)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    rows = []
    for (a, b), linked in zip(sides, links):
        cuts = set(a[1]) & set(b[1])
        ends = [[k for k, e in enumerate(side[1]) if e in cuts] for side in (a, b)]
        slices = [[side[0][x + 1:y + 1] for x, y in zip([-1, *at], at)] for side, at in zip((a, b), ends)]
        groups = ["|".join(",".join(map(str, ids)) for ids in pair) for pair in zip(*slices)]
        text = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((len(a[0]), len(b[0]), len(groups), len(linked), sum(count[p] == highest[p[1]] for p in linked), sum(count[p] for p in linked), text))
    return rows


def test_parts_equal_the_whole_text(both):
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", ",", "é", "日", ".", "!?", "²", "_", "\r", "the", "'s", "1", "\xa0", "\x1c", "▁", " the", "ing"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(8_000)]
    made = both[2]
    for text in texts:
        parts = made.parts(text)
        assert "".join(parts) == (" " + text if text else "")
        made.learn(set(parts))
        found = [made.number[p] for p in parts]
        spelt = not made.sizes[found, 4].any() if found else True
        (a, _), (b, _) = tokens_of(text, both)
        if not a:
            assert not found or not spelt, repr(text)
            continue
        assert spelt, repr(text)
        joined = ";".join(made.groups[k] for k in found).split(";")
        assert [int(i) for g in joined for i in g.split("|")[0].split(",")] == a, repr(text)
        assert [int(i) for g in joined for i in g.split("|")[1].split(",")] == b, repr(text)


def test_query(spark, few_docs, odd_docs, both, tmp_path):
    made = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id bigint, text string")
    for i, docs in enumerate((few_docs, made, odd_docs, odd_docs.limit(0))):
        docs.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        rows = queries.QUERIES["op11_alignment"](spark, f"{tmp_path}/{i}")
        assert rows.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        source = docs.collect()
        wanted = sorted((str(r.doc_id), *x) for r, x in zip(source, brute([r.text for r in source], both)))
        assert sorted((str(r[0]), *r[1:8]) for r in rows.collect()) == wanted


def test_pairs_end_alike(both):
    """The bound on distinct pairs: of two linked tokens one ends with the other."""
    made = both[2]
    for text in TEXTS:
        (a, ends_a), (b, ends_b) = tokens_of(text, both)
        for e in set(ends_a) & set(ends_b):
            x, y = made.first_bytes[a[ends_a.index(e)]], made.second_bytes[b[ends_b.index(e)]]
            assert x.endswith(y) or y.endswith(x)


def test_operator_keeps_groups(spark):
    rows = {r.doc_id: r for r in align.align(spark.createDataFrame([(1, "tokenization"), (2, "a b")], "doc_id bigint, text string")).collect()}
    assert rows[2].groups.count(";") == 1 and rows[1].groups.count("|") == rows[1].n_groups == rows[1].n_links


def test_forgetting_changes_nothing(spark, few_docs, monkeypatch):
    rows = sorted(map(str, align.align(few_docs).collect()))
    monkeypatch.setattr(align, "CACHE", 50)
    assert sorted(map(str, align.align(few_docs.repartition(9)).collect())) == rows
