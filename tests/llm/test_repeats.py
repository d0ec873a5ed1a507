import hashlib
import random
from collections import Counter

import numpy as np

from ledgerline.llm import repeats


def slow(texts, size=200):
    seen = Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - size + 1):
            if seen[t[i:i + size]] > 1:
                cover[i:i + size] = True
        parts = int((cover & ~np.r_[False, cover[:-1]]).sum()) if len(t) else 0
        out.append((len(t), int(cover.sum()), parts, hashlib.sha256(np.frombuffer(t, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    wanted = Counter((r.doc_id, *w) for r, w in zip(rows, slow([(r.text or "").encode() for r in rows])))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()) == wanted


def test_equals_brute_force(few_docs):
    check(few_docs)


def test_edited_copies_periods_and_borders(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéo") for _ in range(rng.randint(1, 9)))
    base = " ".join(word() for _ in range(600))
    texts = [base, base, base[:200], base[1:200], base[300:499], base[300:501], "ab" * 400, "ba" * 150, "a" * 199, "a" * 200, "a" * 500, "", None, base[:700] + "#" + base[701:], base + base[:250]]
    for _ in range(15):
        t = base
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "x", word()]) + t[at + rng.randint(0, 3):]
        texts.append(t[rng.randrange(400):])
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_odd_rows(odd_docs):
    check(odd_docs)
    assert repeats.remove_repeats(odd_docs.limit(0)).count() == 0
